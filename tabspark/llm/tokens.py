"""Token ids of whole texts by a public byte-level BPE vocabulary.

Long texts are cut into overlapping chunks, rows of their own that spread over all tasks and are split into pre-tokens each
on its own. Splitting looks only ahead, so once two neighbouring chunks share a boundary in their overlap they agree from
there on; the text is divided at such boundaries and the pieces are encoded as if they were texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.session import cut_lineage, fresh, quoted

TOKENIZERS = "/opt/tokenizers"
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary file, and how long texts are cut (characters)."""

    file: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    chunk: int = 50_000
    overlap: int = 1_000


@lru_cache(maxsize=4)
def load_tokenizer(file: str):  # noqa: ANN201
    """The tokenizer, once per Python worker; its own threads are off, as each task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    return tokenizer


def boundaries(tokenizer, text: str) -> np.ndarray:  # noqa: ANN001
    """Where pre-tokens start in the text, and its length."""
    return np.array([start for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)] + [len(text)], np.int64)


def _cuttable(text: str, found: np.ndarray) -> np.ndarray:
    """The boundaries after a character that is no white space: what follows white space decides how that is split."""
    return np.array([b for b in found.tolist() if b > 0 and not text[b - 1].isspace()], np.int64)


def divide(tokenizer, text: str, chunk: int, overlap: int) -> list[str]:  # noqa: ANN001
    """The text in pieces that start at true pre-token boundaries, one after the other, in one task.

    From a true boundary on, all boundaries of a longer stretch are true but those within its last two characters; the last
    of them is where the next piece starts. A stretch without one is looked at again at twice the length, so a text without
    boundaries takes no more than twice the time of its last look.
    """
    cuts, start, length = [0], 0, chunk
    while len(text) - start > length + overlap:
        stretch = text[start : start + length + overlap]
        found = _cuttable(stretch, boundaries(tokenizer, stretch))
        found = found[found < len(stretch) - 2]
        if len(found):
            start, length = start + int(found[-1]), chunk
            cuts.append(start)
        else:
            length *= 2
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encode_batch(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one after the other, and the number of ids of each text; null and empty texts have none."""
    tokenizer = load_tokenizer(vocabulary.file)
    pieces: list[str] = []
    owner: list[int] = []
    for n, text in enumerate(texts):
        if text:
            parts = divide(tokenizer, text, vocabulary.chunk, vocabulary.overlap)
            pieces += parts
            owner += [n] * len(parts)
    ids = pa.array([e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], pa.list_(pa.int32()))
    lengths = np.diff(ids.offsets.to_numpy())
    counts = np.bincount(np.array(owner, np.int64), lengths, len(texts)).astype(np.int64)
    return ids.values.to_numpy(), counts


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of whole ids: their bytes, put together and read as UTF-8."""
    table = _bytes_of(vocabulary.file)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _bytes_of(file: str) -> dict[int, bytes]:
    """Each id's bytes. Byte-level vocabularies write a byte as a printable character: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in load_tokenizer(file).get_vocab().items()}


def encode_corpus(df: DataFrame, text: str, vocabulary: Vocabulary = Vocabulary(), ids: str | None = "ids", count: str | None = None) -> DataFrame:
    """``df`` without the text, with ``ids`` (array of int) and/or ``count`` (bigint): the token ids of each whole text.

    Empty and null texts have an empty list and the count 0. Special tokens' strings are ordinary text. Rows are kept one
    for one; an empty table gives an empty one; existing columns with an output name are replaced. Texts of one chunk are
    encoded where they lie, in slices of bounded size. Longer ones are written to the shared folder, cut into chunks that
    spread over the tasks, and put together again: see encode_long. On a stream they are encoded where they lie, too.
    """
    if text not in df.columns:
        raise SchemaError(f"no column {text!r}")
    kept = [c for c in df.columns if c not in (text, ids, count)]
    source, row, part = fresh([*kept, *(c for c in (ids, count) if c)], "_text", "_row", "_part")
    slim = df.select(*[quoted(c) for c in kept], quoted(text).alias(source))
    if df.isStreaming:
        return _encode_rows(slim, source, vocabulary, ids, count)
    # A text has no more characters than bytes, which are known without counting.
    most = vocabulary.chunk + vocabulary.overlap
    is_long = (F.octet_length(source) > most) & (F.char_length(source) > most)
    long = slim.where(is_long)
    if long.isEmpty():
        return _encode_rows(slim, source, vocabulary, ids, count)
    short = _encode_rows(slim.where(F.col(source).isNull() | ~is_long), source, vocabulary, ids, count)
    long = cut_lineage(long.withColumn(row, F.monotonically_increasing_id()))
    encoded = encode_long(long.select(F.col(row).alias("row"), F.col(source).alias("text")), vocabulary, ids is not None)
    encoded = encoded.select(F.col("row").alias(part), *([F.col("ids").alias(ids)] if ids else []), *([F.col("n").alias(count)] if count else []))
    return short.unionByName(long.drop(source).join(encoded, F.col(row) == F.col(part)).drop(row, part))


def _encode_rows(df: DataFrame, source: str, vocabulary: Vocabulary, ids: str | None, count: str | None) -> DataFrame:
    """``df`` without ``source``, each text encoded in its row's task."""
    kept = [c for c in df.columns if c != source]
    schema = T.StructType(list(df.select(*[quoted(c) for c in kept]).schema.fields))
    if ids:
        schema = schema.add(ids, T.ArrayType(T.IntegerType()))
    if count:
        schema = schema.add(count, T.LongType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // SLICE_BYTES
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1) if batch.num_rows else []:
                piece = batch.slice(at[0], len(at))
                flat, counts = encode_batch(piece.column(source).to_pylist(), vocabulary)
                arrays = [piece.column(i) for i in range(len(kept))]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat)))
                if count:
                    arrays.append(pa.array(counts))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[quoted(c) for c in kept], quoted(source)).mapInArrow(encode, schema)


CHUNKS = "row bigint, n bigint, begin bigint, chunk string"


def cut_chunks(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, n, begin, chunk): the overlapping chunks of (row, text), spread over the tasks."""
    length, overlap = vocabulary.chunk, vocabulary.overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begins = list(range(0, max(len(text) - overlap, 1), length))
                for at in range(0, len(begins), 64):  # a few chunks at a time, not a whole text once more
                    some = begins[at : at + 64]
                    chunks = [text[b : b + length + overlap] if b != begins[-1] else text[b:] for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.int64()), pa.array(chunks, pa.string())], names=["row", "n", "begin", "chunk"])

    return texts.select("row", "text").mapInArrow(cut, CHUNKS).repartition("row", "n")


def encode_long(texts: DataFrame, vocabulary: Vocabulary, with_ids: bool = True) -> DataFrame:
    """(row, ids, n) of (row, text): the token ids (null unless ``with_ids``) and their number of long texts; ``row`` is unique.

    Every chunk is pre-tokenised on its own and keeps its boundaries inside its first and last overlap. The first boundary
    that a chunk shares with the one before is where its piece starts; its own chunk has all of the piece. If a chunk
    shares none (a stretch of the length of an overlap without a boundary), nothing proves where it starts: the
    text is then divided from its beginning by one task, which always can.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary.file)
        for batch in batches:
            heads, tails = [], []
            for n, begin, chunk in zip(*(batch.column(c).to_pylist() for c in ("n", "begin", "chunk")), strict=True):
                found = _cuttable(chunk, boundaries(tokenizer, chunk))
                # What splits behind the end of the chunk is not seen, but for a text's last chunk, which has no next.
                sure = found[found < min(len(chunk) - 2, vocabulary.chunk + vocabulary.overlap - 2)]
                heads.append((sure[sure < vocabulary.overlap] + begin if n else np.array([0])).tolist())
                tails.append((sure[sure >= vocabulary.chunk] + begin).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    looked = cut_lineage(cut_chunks(texts, vocabulary).mapInArrow(look, CHUNKS + ", head array<bigint>, tail array<bigint>"))
    order = Window.partitionBy("row").orderBy("n")
    # One row of numbers a chunk; the chunks themselves do not pass the window.
    marks = looked.select("row", "n", F.when(F.col("n") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_intersect("head", F.lag("tail").over(order))).alias("shared"))
    marks = marks.select("row", "n", F.array_min("shared").alias("cut"))
    marks = marks.select("row", "n", "cut", F.lead("cut").over(order).alias("stop"), F.min(F.col("cut").isNotNull()).over(Window.partitionBy("row")).alias("proven"))
    marks = cut_lineage(marks)
    own = looked.select("row", "n", "begin", "chunk").join(marks.where("proven"), ["row", "n"])
    length = F.coalesce(F.col("stop") - F.col("cut"), F.lit(2**31 - 1)).cast("int")
    pieces = own.select("row", "n", F.substring("chunk", (F.col("cut") - F.col("begin") + 1).cast("int"), length).alias("piece"))
    encoded = _encode_rows(pieces, "piece", vocabulary, "ids" if with_ids else None, "count")
    # The ids of one text come together, as they are one value of the result.
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])) if with_ids else F.lit(None).cast("array<int>")
    found = encoded.groupBy("row").agg(whole.alias("ids"), F.sum("count").alias("n"))
    unproven = marks.where("not proven").select("row").distinct()
    rest = _encode_rows(texts.join(unproven, "row", "left_semi").select("row", "text"), "text", vocabulary, "ids" if with_ids else None, "n")
    return found.unionByName(rest.select("row", (F.col("ids") if with_ids else F.lit(None).cast("array<int>")).alias("ids"), "n"))
