"""Operators on sets of rows and, with an explicit order, on their places.

Rows of a DataFrame have no places. What needs them takes an order that decides every tie, or else the column ROW_ID that
the readers give: files in the order of their paths, lines in the order of the file. Places are numbered without gathering
rows: ranges or splits are counted, and each starts where those before it end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.operators.columns import require
from tabspark.session import cut_lineage, fresh, quoted

ROW_ID = "_row_id"


def filter_rows(df: DataFrame, *tests: Column) -> DataFrame:
    """The rows for which all tests hold."""
    for test in tests:
        df = df.filter(test)
    return df


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, of the same types, in the same order; repeated rows stay."""
    for other in others:
        if [(f.name, f.dataType) for f in other.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise SchemaError(f"{other.dtypes} is not {first.dtypes}")
        first = first.union(other)
    return first


def _numbered(rows: DataFrame, at: str, splits: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` and ``name``: the places of written rows, of which each of ``splits`` has consecutive numbers ``at``."""
    first, start, *keys = fresh([*rows.columns, name], "_first", "_start", *(f"_k{i}" for i in range(len(splits))))
    sizes = rows.groupBy(*[quoted(s).alias(k) for s, k in zip(splits, keys, strict=True)]).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("_n"))
    # One row for each split of the input, not for each row of it.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, first, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    same = reduce(lambda a, b: a & b, [quoted(s) == F.col(k) for s, k in zip(splits, keys, strict=True)])
    place = F.col(start) + F.col(at) - F.col(first)
    return rows.join(starts, same).select(*[quoted(c) for c in keep if c != name], place.alias(name))


def with_row_index(df: DataFrame, order: list[Column] | None = None, name: str = ROW_ID) -> DataFrame:
    """``df`` with the place of each row from 0 as last column, by ``order`` or else by the ROW_ID that a reader gave.

    Without either SchemaError is raised, as the rows then have no order. They are sorted into ranges and written to the
    shared folder with their places inside their ranges, so that both passes see the same.
    """
    if not order and ROW_ID not in df.columns:
        raise SchemaError(f"rows have no places: give an order, or read the table with {ROW_ID}")
    at, part = fresh([*df.columns, name], "_at", "_part")
    rows = df.orderBy(*(order or [quoted(ROW_ID)])).withColumn(at, F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn(part, F.shiftright(F.col(at), 33)))
    return _numbered(rows, at, [part], df.columns, name)


def place_by_file(df: DataFrame, file: str, block: str, name: str = ROW_ID) -> DataFrame:
    """``df`` without its columns ``file`` and ``block``, with the place of each row from 0 in a folder.

    ``block`` is the first byte of the split from which a row came, and a task has the rows of a split in their order. No
    row moves: they are written once, their splits counted, and each split starts where those before it end.
    """
    (at,) = fresh([*df.columns, name], "_at")
    rows = cut_lineage(df.withColumn(at, F.monotonically_increasing_id()))
    return _numbered(rows, at, [file, block], [c for c in df.columns if c not in (file, block)], name)


def _without_id(df: DataFrame, order: list[Column] | None) -> list[str]:
    """The columns that hold data: a ROW_ID that is the order does not."""
    return [c for c in df.columns if order or c != ROW_ID]


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[Column] | None = None, order_b: list[Column] | None = None) -> DataFrame:
    """The columns of both for rows of equal place; as many rows as the shorter has. Column names must differ.

    A ROW_ID by which a table is ordered is not in the result.
    """
    left, right = _without_id(a, order_a), _without_id(b, order_b)
    if both := set(left) & set(right):
        raise SchemaError(f"columns in both tables: {sorted(both)}")
    place_a, place_b = fresh([*a.columns, *b.columns], "_place_a", "_place_b")
    placed_a = with_row_index(a, order_a, place_a).select(*[quoted(c) for c in left], place_a)
    placed_b = with_row_index(b, order_b, place_b).select(*[quoted(c) for c in right], place_b)
    return placed_a.join(placed_b, F.col(place_a) == F.col(place_b)).select(*[quoted(c) for c in left + right])


def zip_with(a: DataFrame, b: DataFrame, function: Callable[[DataFrame], Column], out: str, order_a: list[Column] | None = None, order_b: list[Column] | None = None) -> DataFrame:
    """One column: a function of the rows of equal place."""
    both = zip_rows(a, b, order_a, order_b)
    return both.select(function(both).alias(out))


def constant(df: DataFrame, value: Column, name: str) -> DataFrame:
    """As many rows of a constant as ``df`` has, next to its columns."""
    return df.withColumn(name, value)


def flat_map(df: DataFrame, rows: Column, *keep: str) -> DataFrame:
    """For each row the structs of the array ``rows`` as rows, after the columns to keep; none for an empty or null array."""
    require(df, *keep)
    return df.select(*[quoted(k) for k in keep], F.inline(rows))


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One new row for each row."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def equal_tables(a: DataFrame, b: DataFrame, order_a: list[Column] | None = None, order_b: list[Column] | None = None) -> bool:
    """Whether both have the same columns and, place by place, the same rows; nulls are equal to nulls.

    A ROW_ID by which a table is ordered is not compared.
    """
    kinds = [[(c, df.schema[c].dataType) for c in _without_id(df, order)] for df, order in ((a, order_a), (b, order_b))]
    if kinds[0] != kinds[1]:
        return False
    left = with_row_index(a, order_a, "_i").select(F.col("_i"), F.struct(*[quoted(c) for c, _ in kinds[0]]).alias("_a"))
    right = with_row_index(b, order_b, "_j").select(F.col("_j"), F.struct(*[quoted(c) for c, _ in kinds[1]]).alias("_b"))
    differ = left.join(right, F.col("_i") == F.col("_j"), "full").where(F.col("_i").isNull() | F.col("_j").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    return differ.isEmpty()


def length(df: DataFrame) -> int:
    return df.count()


def row_at(df: DataFrame, place: int, order: list[Column] | None = None) -> DataFrame:
    """The row at a place from 0; no row if there are fewer."""
    return with_row_index(df, order, "_i").where(F.col("_i") == place).drop("_i")


def take_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first rows; each task keeps only its own first ``n``."""
    return df.orderBy(*order).limit(max(n, 0))


def drop_rows(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """All but the first rows, without passing them through one task."""
    return with_row_index(df, order, "_i").where(F.col("_i") >= n).drop("_i")


def chunk_ids(df: DataFrame, size: int, order: list[Column] | None = None, name: str = "chunk") -> DataFrame:
    """The rows with the number of their chunk, from 0, of ``size`` rows each; the last may be shorter."""
    if size < 1:
        raise ValueError("a chunk has at least one row")
    return with_row_index(df, order, "_i").withColumn(name, F.floor(F.col("_i") / size)).drop("_i")


def chunk_sizes(df: DataFrame, size: int, trailing_empty: bool = False) -> DataFrame:
    """(chunk, n): the chunks' sizes. As a stream delivers them, full chunks are followed by an empty one."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    last = F.ceil(F.col("n") / size) + (F.when(F.col("n") % size == 0, 1).otherwise(0) if trailing_empty else 0)
    each = total.where(last > 0).select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint") - 1)).alias("chunk"))
    return each.select("chunk", F.least(F.lit(size), F.col("n") - F.col("chunk") * size).cast("bigint").alias("n"))


def chunk_heads(df: DataFrame, size: int, order: list[Column] | None = None) -> DataFrame:
    """The first row of each chunk, with the chunk's number."""
    marked = with_row_index(df, order, "_i")
    return marked.where(F.col("_i") % size == 0).withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i")


def arg_max(df: DataFrame, by: Column, *ties: Column) -> DataFrame:
    """The row with the greatest value; among several, that which is greatest by ``ties``. No row for an empty table."""
    best = df.agg(F.max_by(F.struct(*[quoted(c) for c in df.columns]), F.struct(by.isNotNull(), by, *ties)).alias("_row"))
    return best.where("_row is not null").select("_row.*")
