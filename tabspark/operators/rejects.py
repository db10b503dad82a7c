"""Records of delimited text, split into typed rows and records that do not parse, with the reason.

Structural indexing over Arrow batches: numpy masks find every quote and comma of a batch at once. In a record whose
quotes alternate between opening and closing ones, prefix parity of the quote mask tells delimiters from commas inside
quotes. The other records are walked field by field, all of them side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.session import fresh, quoted

QUOTE, COMMA, RETURN = 34, 44, 13
INT_FORM, DOUBLE_FORM = r"^-?[0-9]+(?:\.0)?$", r"^-?[0-9]+(?:\.[0-9]+)?$"
SLICE_BYTES = 16_000_000


@dataclass
class Fields:
    """Where the fields of a batch lie: record number, first byte, byte after the last, and whether it is quoted."""

    record: np.ndarray
    start: np.ndarray
    end: np.ndarray
    quoted: np.ndarray


def gather(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of ``buffer`` as an Arrow array of texts."""
    lengths = end - start
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[at])])


def _first_from(positions: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each ``at`` the first of the sorted ``positions`` not before it, or ``limit`` if that is not below it."""
    n = np.searchsorted(positions, at)
    found = positions[np.minimum(n, max(len(positions) - 1, 0))] if len(positions) else limit
    return np.where((n < len(positions)) & (found < limit), found, limit)


def index_structure(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[Fields, np.ndarray]:
    """Fields of all records whose quoting holds, in order, and for each record whether it does not.

    ``begin`` and ``end`` are the records' byte ranges, in order.
    """
    count = len(begin)
    quotes, commas = np.flatnonzero(buffer == QUOTE), np.flatnonzero(buffer == COMMA)
    of = lambda at: np.searchsorted(begin, at, "right") - 1
    inside = lambda at, r: at[(r >= 0) & (at < end[np.maximum(r, 0)])]
    quotes, commas = (inside(x, of(x)) if count else x[:0] for x in (quotes, commas))
    q_rec, c_rec = of(quotes), of(commas)
    after, before = np.append(buffer, COMMA)[quotes + 1], buffer[np.maximum(quotes - 1, 0)]
    opens, closes = (quotes == begin[q_rec]) | (before == COMMA), (quotes + 1 == end[q_rec]) | (after == COMMA)
    first = np.searchsorted(quotes, begin)
    number = np.searchsorted(quotes, end) - first
    parity = (np.arange(len(quotes)) - first[q_rec]) & 1
    uneven = (number & 1).astype(bool)
    uneven[q_rec[np.where(parity == 0, ~opens, ~closes)]] = True

    even = ~uneven[c_rec] & (((np.searchsorted(quotes, commas) - first[c_rec]) & 1) == 0)
    cut, cut_rec = commas[even], c_rec[even]
    whole = np.flatnonzero(~uneven)
    rec, start = np.concatenate([whole, cut_rec]), np.concatenate([begin[whole], cut + 1])
    order = np.lexsort((start, rec))
    rec, start = rec[order], start[order]
    last = np.append(rec[1:] != rec[:-1], True)[: len(rec)]
    stop = np.where(last, end[rec], np.append(start[1:], 0)[: len(start)] - 1)
    parts = [(rec, start, stop, (start < stop) & (np.append(buffer, 0)[start] == QUOTE))]

    # Records with other quotes: one field of each at a time.
    broken = np.zeros(count, bool)
    closers = quotes[closes]
    rec = np.flatnonzero(uneven)
    at = begin[rec]
    while len(rec):
        limit = end[rec]
        is_quoted = (at < limit) & (np.append(buffer, 0)[at] == QUOTE)
        close, comma = _first_from(closers, at + 1, limit), _first_from(commas, at, limit)
        stop = np.where(is_quoted, close + 1, comma)
        bad = np.where(is_quoted, close >= limit, _first_from(quotes, at, limit) < comma)
        broken[rec[bad]] = True
        parts.append((rec[~bad], at[~bad], stop[~bad], is_quoted[~bad]))
        more = ~bad & (stop < limit)
        rec, at = rec[more], stop[more] + 1
    rec, start, stop, is_quoted = (np.concatenate(x) for x in zip(*parts, strict=True))
    good = ~broken[rec]
    order = np.lexsort((start[good], rec[good]))
    return Fields(*(x[good][order] for x in (rec, start, stop, is_quoted))), broken


def field_texts(buffer: np.ndarray, fields: Fields, pick: np.ndarray) -> pa.Array:
    """Contents of the picked fields: quoted ones without their quotes, others without outer spaces."""
    q = fields.quoted[pick]
    texts = gather(buffer, fields.start[pick] + q, fields.end[pick] - q)
    return pc.if_else(pa.array(q), texts, pc.utf8_trim(texts, " "))


def judge_records(records: pa.Array, files: pa.Array, layout: dict[str, list[str]], with_fields: bool) -> tuple[pa.Array, pa.Array | None]:
    """Reasons (null: valid) and, if wanted, the texts of the fields of valid records (else null)."""
    records = pc.fill_null(records.cast(pa.large_string()), "")
    offsets = np.frombuffer(records.buffers()[1], np.int64)[records.offset : records.offset + len(records) + 1]
    data = records.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and len(offsets) and offsets[-1] else np.zeros(0, np.uint8)
    begin, end = offsets[:-1].copy(), offsets[1:].copy()
    if len(buffer):
        end -= (end > begin) & (buffer[np.maximum(end - 1, 0)] == RETURN)
    fields, broken = index_structure(buffer, begin, end)
    names = sorted(layout)
    file_no = pc.fill_null(pc.index_in(files.cast(pa.string()), pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False).astype(int)
    width = np.array([len(layout[f]) for f in names] + [-1])[file_no]
    number = np.bincount(fields.record, minlength=len(begin))
    reason = np.full(len(begin), None, object)
    reason[number != width] = "column_count"
    reason[broken] = "quoting"
    reason[file_no < 0] = "unknown_file"
    place = np.arange(len(fields.record)) - np.searchsorted(fields.record, fields.record)
    sound = (reason == None)[fields.record]  # noqa: E711
    kinds = np.full((len(names) + 1, max([len(x) for x in layout.values()], default=0) + 1), "text", object)
    for i, name in enumerate(names):
        kinds[i, : len(layout[name])] = layout[name]
    kind = np.full(len(place), "text", object)
    kind[sound] = kinds[file_no[fields.record[sound]], place[sound]]
    for wanted, form in (("int", INT_FORM), ("double", DOUBLE_FORM)):
        pick = np.flatnonzero(kind == wanted)
        if not len(pick):
            continue
        texts = field_texts(buffer, fields, pick)
        empty = pc.is_in(texts, pa.array(["", "NA"], pa.large_string()))
        fits = pc.match_substring_regex(pc.replace_substring(texts, ",", "") if wanted == "double" else texts, form)
        bad = ~(pc.or_(empty, fits).to_numpy(zero_copy_only=False))
        reason[fields.record[pick[bad]]] = "bad_value"
    found = pa.array(reason, pa.string())
    if not with_fields:
        return found, None
    valid = reason == None  # noqa: E711
    pick = np.flatnonzero(valid[fields.record])
    texts = field_texts(buffer, fields, pick)
    texts = pc.if_else(pa.array(fields.quoted[pick]), pc.replace_substring(texts, '""', '"'), texts)
    bounds = np.concatenate([[0], np.cumsum(np.where(valid, number, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), texts.cast(pa.string()), mask=pa.array(~valid))
    return found, lists


def read_layout(columns: DataFrame, most: int = 10_000) -> dict[str, list[tuple[str, str]]]:
    """(name, type) of each file's columns in order. The table describes files, not rows; over ``most`` rows are refused."""
    rows = columns.select("file_name", "col_no", "col_name", "col_type").limit(most + 1).collect()
    if len(rows) > most:
        raise SchemaError(f"more than {most} columns described")
    layout: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: (r.file_name, r.col_no)):
        layout.setdefault(r.file_name, []).append((r.col_name, r.col_type))
    return layout


def split_records(df: DataFrame, record: str, file: str, layout: dict[str, list[tuple[str, str]]], with_fields: bool = True) -> DataFrame:
    """All rows of ``df`` with ``reason`` (null for a valid record) and, if wanted, ``fields`` (texts of a valid record).

    Reasons, the first that holds: ``unknown_file`` (no layout), ``quoting``, ``column_count``, ``bad_value``; see
    TESTDATA.md for their rules. A null record counts as empty text: one empty field. Repeated rows are judged alike and
    kept; an empty table gives an empty one; existing columns ``reason`` and ``fields`` are replaced. Long records are fine:
    batches are taken in slices of bounded size, down to single records.
    """
    for name in (record, file):
        if name not in df.columns:
            raise SchemaError(f"no column {name!r}")
    kept = [c for c in df.columns if c not in ("reason", "fields")]
    texts, files = fresh(kept, "_record", "_file")
    types = {f: [kind for _, kind in cols] for f, cols in layout.items()}
    source = df.select(*[quoted(c) for c in kept], quoted(record).alias(texts), quoted(file).alias(files))
    schema = T.StructType([*df.select(*[quoted(c) for c in kept]).schema.fields, T.StructField("reason", T.StringType())])
    if with_fields:
        schema = schema.add("fields", T.ArrayType(T.StringType()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
            for n in range(0, batch.num_rows, step):
                part = batch.slice(n, step)
                reason, fields = judge_records(part.column(texts), part.column(files), types, with_fields)
                arrays = [part.column(i) for i in range(len(kept))] + [reason] + [fields] * with_fields
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(judge, schema)


def valid_rows(split: DataFrame, file: str, name: str, layout: dict[str, list[tuple[str, str]]], keep: list[str]) -> DataFrame:
    """The valid records of one file as typed rows: the ``keep`` columns, then the file's own.

    ``int`` becomes bigint and ``double`` double; empty and ``NA`` cells of these are null, as are whole numbers beyond
    64 bits; text stays as it is. A file column whose name is also in ``keep`` gets a leading underscore.
    """
    kinds = {"int": "bigint", "double": "double"}
    names = fresh(keep, *[c or "_empty" for c, _ in layout[name]])
    cells = []
    for i, (out, (_, kind)) in enumerate(zip(names, layout[name], strict=True)):
        text = F.col("fields")[i]
        if kind == "int":
            text = F.regexp_replace(text, r"\.0\z", "")
        elif kind == "double":
            text = F.replace(text, F.lit(","), F.lit(""))
        cells.append((text.try_cast(kinds[kind]) if kind in kinds else text).alias(out))
    return split.where(F.col("reason").isNull() & (quoted(file) == name)).select(*[quoted(k) for k in keep], *cells)
