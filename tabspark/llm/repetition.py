"""Repetition inside single documents: tokenizer fertility with bands per script, and exact repeated stretches.

Fertility (characters per token, share of byte-fallback tokens, token entropy) tells texts that a vocabulary reads in an
unusual way from others of their script. It cannot tell which characters lie in a stretch seen before, so the share of
repeated characters is measured on the text itself, by comparing all stretches of a fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.llm.quantiles import combine, percentiles, summarise
from tabspark.llm.tokens import TOKENIZERS, Vocabulary, encode_batch
from tabspark.session import cut_lineage, fresh, quoted

SLICE_CHARS = 2_000_000
FERTILITY = ["chars_per_token", "fallback_share", "token_entropy"]
LEAST_SPREAD = {"chars_per_token": 0.2, "fallback_share": 0.01, "token_entropy": 0.01}
# Scripts told apart, by ranges of code points.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "cyrillic": [(0x400, 0x52F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "greek": [(0x370, 0x3FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "arabic": [(0x600, 0x6FF)],
    "devanagari": [(0x900, 0x97F)],
}


@lru_cache(maxsize=1)
def kept_table() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(chars: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each stretch of ``length`` characters."""
    mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(len(chars) - length + 1, np.uint64)
    for j in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (mixed[j : j + len(out)] ^ (mixed[j : j + len(out)] >> np.uint64(29)))
    return out


def repeated_counts(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its kept characters, and those in a stretch of ``length`` that also begins at an earlier place.

    Texts are lowered and keep only letters and digits. Equal hashes are compared character by character; the texts of a
    false match are done again by a dictionary.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = code_points(lowered)
    keep = kept_table()[codes]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])[keep]
    chars = codes[keep]
    kept = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if len(chars) < length:
        return kept, np.zeros(len(texts), np.int64)
    hashes = _hashes(chars, length)
    at = np.flatnonzero(doc[: len(hashes)] == doc[length - 1 :])
    key = hashes[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    here, before = at[again + 1], at[again]
    same = doc[here] == doc[before]
    for j in range(length):
        same &= chars[here + j] == chars[before + j]
    marks = np.zeros(len(chars) + 1, np.int64)
    np.add.at(marks, here[same], 1)
    np.add.at(marks, here[same] + length, -1)
    repeated = np.bincount(doc, np.cumsum(marks[:-1]) > 0, len(texts)).astype(np.int64)
    for d in np.unique(doc[np.concatenate([here[~same], before[~same]])]):
        own = chars[doc == d].tobytes()
        seen, covered = set(), np.zeros(len(own) // 4, bool)
        for i in range(len(covered) - length + 1):
            window = own[4 * i : 4 * (i + length)]
            if window in seen:
                covered[i : i + length] = True
            seen.add(window)
        repeated[d] = covered.sum()
    return kept, repeated


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1) if batch.num_rows else []:
        yield batch.slice(at[0], len(at))


def _per_row(df: DataFrame, text: str, out: list[T.StructField], work) -> DataFrame:  # noqa: ANN001
    """``df`` without the text, with the columns that ``work`` gives for a list of texts. No row moves."""
    if text not in df.columns:
        raise SchemaError(f"no column {text!r}")
    kept = [c for c in df.columns if c != text and c not in {f.name for f in out}]
    (source,) = fresh(kept, "_text")
    schema = T.StructType([*df.select(*[quoted(c) for c in kept]).schema.fields, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, source, SLICE_CHARS):
                arrays = [part.column(i) for i in range(len(kept))] + [pa.array(x) for x in work(part.column(source).to_pylist())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[quoted(c) for c in kept], quoted(text).alias(source)).mapInArrow(run, schema)


def repeated_share(df: DataFrame, text: str, length: int = 30) -> DataFrame:
    """``df`` without the text, with kept_chars and repeated_chars (bigint) of each whole text.

    Null and empty texts, and those too short for two stretches, have nothing repeated. Rows are kept one for one, exact
    copies too; an empty table gives an empty one; existing columns of these names are replaced. Overlapping stretches
    count, so a run of one character repeats itself. Memory is about 60 bytes a character of the longest text.
    """
    out = [T.StructField("kept_chars", T.LongType()), T.StructField("repeated_chars", T.LongType())]
    return _per_row(df, text, out, lambda texts: repeated_counts(texts, length))


@lru_cache(maxsize=2)
def _pieces(model: str):  # noqa: ANN202
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    return pieces, np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])


def fertility(df: DataFrame, text: str, vocabulary: Vocabulary = Vocabulary(), fallback_model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """``df`` without the text, with script, n_tokens, chars_per_token, fallback_share and token_entropy of each whole text.

    token_entropy is the entropy of the text's tokens over the highest it could have, log2 of their number; with fewer
    than two tokens it is null. fallback_share is the share of single-byte pieces under a vocabulary with byte fallback.
    script is that of most of its letters, ``other`` without any. Null and empty texts have no tokens and null measures.
    """

    def measure(texts: list[str | None]) -> list:
        ids, counts = encode_batch(texts, vocabulary)
        owner = np.repeat(np.arange(len(texts)), counts)
        chars = np.array([len(t or "") for t in texts], float)
        pairs, times = np.unique(owner.astype(np.int64) << 32 | ids, return_counts=True)
        spread = np.bincount(pairs >> 32, times * np.log2(times), len(texts)) if len(pairs) else np.zeros(len(texts))
        some, many = counts > 0, counts > 1
        per = np.where(some, chars / np.maximum(counts, 1), np.nan)
        logs = np.log2(np.maximum(counts, 2))
        entropy = np.where(many, (logs - spread / np.maximum(counts, 1)) / logs, np.nan)
        pieces, is_byte = _pieces(fallback_model)
        encoded = pieces.encode([t or "" for t in texts], num_threads=1)
        fallback = np.array([is_byte[p].mean() if p else np.nan for p in encoded])
        codes = code_points([t or "" for t in texts])
        doc = np.repeat(np.arange(len(texts)), chars.astype(int))
        votes = np.stack([np.bincount(doc, reduce(np.logical_or, [(codes >= a) & (codes <= b) for a, b in ranges]), len(texts)) for ranges in SCRIPTS.values()]) if len(texts) else np.zeros((len(SCRIPTS), 0))
        names = np.array([*SCRIPTS, "other"], object)[np.where(votes.max(axis=0) > 0, votes.argmax(axis=0), len(SCRIPTS))]
        null = lambda x: pa.array(x, mask=np.isnan(x))
        return [pa.array(names, pa.string()), counts, null(per), null(fallback), null(entropy)]

    out = [T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in FERTILITY]]
    return _per_row(df, text, out, measure)


def fertility_bands(measured: DataFrame, group: str = "script", reach: float = 3.0, error: float = 0.005) -> DataFrame:
    """(group, measure, low, high): texts of a group outside the band of a measure are unusual.

    A band reaches ``reach`` quartile distances, taken as LEAST_SPREAD where they are less, beyond the quartiles of all
    texts of the group, whose ranks are off by at most ``error`` of its texts.
    """
    found = percentiles(combine(summarise(measured, [group], FERTILITY, error), [group], error), [group], [0.25, 0.75])
    wide = found.groupBy(group, "measure").agg(F.min("value").alias("q1"), F.max("value").alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair]), F.col("measure")))
    return wide.select(group, "measure", (F.col("q1") - reach * spread).alias("low"), (F.col("q3") + reach * spread).alias("high"))


def outside_bands(df: DataFrame, text: str, reach: float = 3.0) -> DataFrame:
    """fertility of each text with ``outside``: the measures that lie outside the bands of its script, in order (maybe none)."""
    measured = cut_lineage(fertility(df, text))
    bands = fertility_bands(measured, reach=reach).groupBy("script").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("bands"))
    # At most one row per script, a fixed list.
    joined = measured.join(F.broadcast(bands.withColumnRenamed("script", "_script")), F.col("script") == F.col("_script"), "left").drop("_script")
    tests = [F.when((F.col(m) < F.col("bands")[m]["low"]) | (F.col(m) > F.col("bands")[m]["high"]), F.lit(m)) for m in FERTILITY]
    return joined.withColumn("outside", F.filter(F.array(*tests), lambda x: x.isNotNull())).drop("bands")
