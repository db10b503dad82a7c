"""Percentiles with a stated rank error, from summaries that combine across partitions and days.

A summary is a sorted list of values of the data, each with the lowest and highest rank it can have. Its uncertainty is
half the largest gap between one value's lowest and the next one's highest rank: any rank is answered within it. Merging
adds the uncertainties of the parts in rows, so their share of all rows does not grow; compressing spends what is still
permitted. All steps are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.session import quoted

FAN_IN = 64
CHUNK = 65_536
MOST_WAITING = 1 << 20  # numbers of a partition that wait to be summarised, over all groups


@dataclass
class Summary:
    """Values in order, bounds of their ranks (from 1), the number of rows and how often it was compressed."""

    values: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: int
    level: int = 0

    @property
    def uncertainty(self) -> float:
        """Ranks by which an answer can be off."""
        return float((self.high[1:] - self.low[:-1]).max() / 2) if len(self.values) > 1 else 0.0


def exact_summary(values: np.ndarray) -> Summary:
    """The summary of all values: the first and last rank of each distinct one."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    ranks = np.unique(np.concatenate([first, np.append(first[1:], len(ordered)) - 1])) if len(ordered) else first
    return Summary(ordered[ranks], ranks + 1, ranks + 1, len(ordered))


def merge(a: Summary, b: Summary) -> Summary:
    """One summary of the rows of both; equal values of ``a`` come first."""

    def ranks(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y.values, x.values, side)
        return x.low + np.append(0, y.low)[at], x.high + np.append(y.high - 1, y.n)[at]

    if not a.n or not b.n:
        return a if a.n else b
    low_a, high_a = ranks(a, b, "left")
    low_b, high_b = ranks(b, a, "right")
    values = np.concatenate([a.values, b.values])
    order = np.argsort(values, kind="stable")
    return Summary(values[order], np.concatenate([low_a, low_b])[order], np.concatenate([high_a, high_b])[order], a.n + b.n, max(a.level, b.level))


def permitted(level: int, error: float) -> float:
    """The share of rows by which a summary compressed ``level`` times may be off; it never reaches ``error``."""
    return error * (1 - 0.5**level)


def compress(s: Summary, error: float) -> Summary:
    """The summary with as few values as the next level's permitted uncertainty needs; both ends stay."""
    room = 2 * permitted(s.level + 1, error) * s.n
    keep, at, last = [0], 0, len(s.values) - 1
    while at < last:
        at = min(max(int(np.searchsorted(s.high, s.low[at] + room, "right")) - 1, at + 1), last)
        keep.append(at)
    keep = keep if len(s.values) else []
    return Summary(s.values[keep], s.low[keep], s.high[keep], s.n, s.level + 1)


def merge_all(parts: list[Summary], error: float) -> Summary:
    """Merges in a balanced tree and compresses once at the end."""
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return compress(parts[0], error)


def answer(s: Summary, share: float) -> tuple[float, int, int]:
    """The value for the rank ``ceil(share * n)`` with the bounds of its own rank."""
    rank = max(1, int(np.ceil(share * s.n - 1e-9)))
    best = int(np.argmin(np.maximum(np.abs(s.high - rank), np.abs(rank - s.low))))
    return float(s.values[best]), int(s.low[best]), int(s.high[best])


STATE = [
    T.StructField("n", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("low", T.ArrayType(T.LongType())), T.StructField("high", T.ArrayType(T.LongType())),
]


def _row(s: Summary) -> list:
    return [s.n, s.level, s.values.tolist(), s.low.tolist(), s.high.tolist()]


def group_codes(keys: list[pa.Array], rows: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row that is equal for equal keys (nulls are equal), and the keys of each number."""
    if not keys:
        return np.zeros(rows, np.int64), [()]
    codes = np.zeros(rows, np.int64)
    for key in keys:
        encoded = key.dictionary_encode("encode")
        # Numbered anew after each key, so that the product stays within the square of the rows.
        codes = np.unique(codes * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(codes, return_index=True)[1]
    return codes, list(zip(*[key.take(pa.array(first)).to_pylist() for key in keys], strict=True))


def summarise(df: DataFrame, groups: list[str], measures: list[str], error: float = 0.005) -> DataFrame:
    """(groups, measure, part, n, level, values, low, high): one summary per input partition, group and measure.

    A null or NaN number counts for nothing; null groups are groups of their own, -0.0 is 0.0 and infinities are ordered.
    A group without numbers has no row. Column names of ``df`` may be anything; ``groups`` must differ from those named
    here. An empty table gives an empty result.
    """
    own = {"measure", "part", *(f.name for f in STATE)}
    if missing := [c for c in [*groups, *measures] if c not in df.columns]:
        raise SchemaError(f"no column {missing}")
    if clash := own.intersection(groups):
        raise SchemaError(f"rename the groups {sorted(clash)}")
    source = df.select(*[quoted(g) for g in groups], *[quoted(m).cast("double").alias(f"_m{i}") for i, m in enumerate(measures)], F.spark_partition_id().alias("_part"))
    fields = [*df.select(*[quoted(g) for g in groups]).schema.fields, T.StructField("measure", T.StringType()), T.StructField("part", T.IntegerType()), *STATE]
    schema = T.StructType(fields)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        part, waiting = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(batch.num_columns - 1)[0].as_py()
            codes, names = group_codes([batch.column(i) for i in range(len(groups))], batch.num_rows)
            for i, measure in enumerate(measures):
                x = batch.column(len(groups) + i).to_numpy(zero_copy_only=False).astype(float) + 0.0
                good = ~np.isnan(x)
                order = np.argsort(codes[good], kind="stable")
                ordered, c = x[good][order], codes[good][order]
                for g, values in zip(np.unique(c), np.split(ordered, np.flatnonzero(np.diff(c)) + 1), strict=False):
                    entry = held.setdefault((names[g], measure), [[], 0, None])
                    entry[0].append(values)
                    entry[1] += len(values)
                    waiting += len(values)
                    if entry[1] >= CHUNK:
                        waiting -= entry[1]
                        _fold(entry)
            if waiting >= MOST_WAITING:
                for entry in held.values():
                    _fold(entry)
                waiting = 0
        rows = []
        for (key, measure), entry in held.items():
            _fold(entry)
            rows.append([*key, measure, part, *_row(compress(entry[2], error))])
        if rows:
            yield _batch(rows, _arrow(schema), schema)

    def _fold(entry: list) -> None:
        """Adds the held rows to the group's summary. Chunks are compressed only once they are merged four at a time."""
        if entry[0]:
            fresh = exact_summary(np.concatenate(entry[0]))
            entry[0], entry[1] = [], 0
            entry[2] = fresh if entry[2] is None else _bounded(merge(entry[2], fresh))

    def _bounded(s: Summary) -> Summary:
        """Within a partition only values that a quarter of the first level's uncertainty can do without are dropped."""
        if len(s.values) <= 16 / error:
            return s
        room, keep, at, last = error * s.n / 4, [0], 0, len(s.values) - 1
        while at < last:
            at = min(max(int(np.searchsorted(s.high, s.low[at] + room, "right")) - 1, at + 1), last)
            keep.append(at)
        return Summary(s.values[keep], s.low[keep], s.high[keep], s.n, s.level)

    return source.mapInArrow(leaf, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def combine(summaries: DataFrame, groups: list[str], error: float = 0.005) -> DataFrame:
    """One summary per group and measure, merged in a tree: at most FAN_IN branches, then their results.

    ``summaries`` comes from summarise or combine, with more columns (days, say) that the result forgets. The uncertainty
    of the result stays below ``error`` times its rows.
    """
    extra = [c for c in summaries.columns if c not in {"measure", *groups, *(f.name for f in STATE)}]
    keyed = summaries.withColumn("_order", F.concat_ws("|", *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in extra]) if extra else F.lit(""))
    keyed = keyed.withColumn("_branch", F.pmod(F.xxhash64("_order"), F.lit(FAN_IN)).cast("string")).select(*[quoted(g) for g in groups], "measure", "_order", "_branch", *[f.name for f in STATE])
    for by in ([*groups, "measure", "_branch"], [*groups, "measure"]):
        schema = T.StructType([*[keyed.schema[c] for c in by], *([T.StructField("_order", T.StringType())] if "_branch" in by else []), *STATE])
        # Keys lie together and in order within a partition, so one pass merges all of its groups.
        keys = [quoted(c) for c in by]
        keyed = keyed.repartition(*keys).sortWithinPartitions(*keys, "_order").mapInArrow(_merger(by, schema, error), schema)
    return keyed


def _merger(by: list[str], schema: T.StructType, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the summaries of each run of rows with equal keys; a run may go on in the next batch."""
    types, branch = _arrow(schema), "_branch" in by

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Summary]]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in [*by, "n", "level"]}
            lists = {c: batch.column(c) for c in ("values", "low", "high")}
            for i, key in enumerate(zip(*[columns[c] for c in by], strict=True)):
                values, low, high = (lists[c][i].values.to_numpy(zero_copy_only=False) for c in ("values", "low", "high"))
                yield key, Summary(values.astype(float), low.astype(np.int64), high.astype(np.int64), columns["n"][i], columns["level"][i])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for key, run in groupby(rows_of(batches), key=lambda r: r[0]):
            parts = [s for _, s in run]
            s = merge_all(parts, error) if len(parts) > 1 else parts[0]
            out.append([*key, *([key[by.index("_branch")]] if branch else []), *_row(s)])
            if len(out) >= 1000:
                yield _batch(out, types, schema)
                out = []
        if out:
            yield _batch(out, types, schema)

    return merged


def _batch(rows: list[list], types: list[pa.DataType], schema: T.StructType) -> pa.RecordBatch:
    arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def percentiles(summaries: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(groups, measure, share, value, n, rank_low, rank_high, rank_error): the value for each share of each summary.

    The wanted rank is ``ceil(share * n)``; the value's own rank is between rank_low and rank_high, so it is off by at
    most rank_error ranks.
    """
    out = [T.StructField("share", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("rank_low", T.LongType()), T.StructField("rank_high", T.LongType())]

    @F.pandas_udf(T.ArrayType(T.StructType(out)))
    def ask(n: pd.Series, values: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        found = []
        for row in zip(n, values, low, high, strict=True):
            s = Summary(np.asarray(row[1], float), np.asarray(row[2], np.int64), np.asarray(row[3], np.int64), int(row[0]))
            found.append([dict(zip(("share", "value", "rank_low", "rank_high"), (p, *answer(s, p)), strict=True)) for p in shares])
        return pd.Series(found)

    rank = F.greatest(F.lit(1), F.ceil(F.col("a.share") * F.col("n") - 1e-9))
    off = F.greatest(F.abs(F.col("a.rank_high") - rank), F.abs(rank - F.col("a.rank_low")))
    asked = summaries.select(*[quoted(g) for g in groups], "measure", "n", F.explode(ask("n", "values", "low", "high")).alias("a"))
    return asked.select(*[quoted(g) for g in groups], "measure", "a.share", "a.value", "n", "a.rank_low", "a.rank_high", off.cast("bigint").alias("rank_error"))
