"""Exact order statistics per group, without ever sorting a whole group in one task.

Radix selection: a group's weighted values are counted in coarse cells of the number line, the cell that holds the rank
is found, and only that cell is divided again. A window never runs over more cells than the cell width allows, however
many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.session import cut_lineage

FINE = 2.0**32


def coarse_cell(x: Column) -> Column:
    """A non-decreasing whole-number function of a double: about 1000 cells for each power of two, zero apart."""
    scale = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * 1024) + 1_200_000  # infinity has a cell of its own
    return F.when(x == 0, 0).when(x > 0, scale).otherwise(-scale).cast("bigint")


def fine_cell(x: Column, coarse: Column) -> Column:
    """Divides a coarse cell again, in the order of ``x``, into about three million cells."""
    start = F.pow(F.lit(2.0), (F.abs(coarse) - 1_200_000) / 1024)
    return F.when(x == 0, 0).otherwise(F.floor((x / start) * FINE)).cast("bigint")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int, how: str = "inner") -> DataFrame:
    """Null-safe equi-join of a large ``left`` with a small ``right`` of unique keys; each key's left rows go to ``salts`` tasks.

    The small side is repeated once per salt, the large side never. ``spread`` is what left rows of one key differ in.
    Columns of ``right`` other than its keys must not be in ``left``.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    other = other.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_salt") == F.col("_r_salt")]
    return salted.join(other, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def exact_medians(values: DataFrame, keys: list[str], value: str, weight: str, salts: int = 16) -> DataFrame:
    """One row per group of ``keys``: ``median``, the middle value, or the mean of the two middle ones.

    ``values`` holds numbers (double) with whole weights; rows with a null value or weight count for nothing, and a group
    without others has no row. Equal values may come in several rows. Column names starting with ``_`` are reserved.
    """
    rows = values.select(*keys, F.col(value).alias("_x"), F.col(weight).cast("bigint").alias("_w")).where("_x is not null and _w > 0")
    rows = rows.withColumn("_x", F.col("_x") + F.lit(0.0)).withColumn("_c1", coarse_cell(F.col("_x"))).withColumn("_c2", fine_cell(F.col("_x"), F.col("_c1")))

    def holding(cells: DataFrame, cell: str, by: list[str], ranks: DataFrame | None) -> DataFrame:
        """The cells in which the wanted ranks lie, with the rank inside the cell."""
        before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if ranks is None:
            run = cells.withColumn("_upto", F.sum("_w").over(before)).withColumn("_n", F.sum("_w").over(Window.partitionBy(*by)))
            run = run.withColumn("_wanted", F.array(((F.col("_n") + 1) / 2).cast("bigint"), (F.col("_n") / 2).cast("bigint") + 1))
        else:
            run = cells.withColumn("_upto", F.sum("_w").over(before))
        inside = F.filter("_wanted", lambda r: (r > F.col("_upto") - F.col("_w")) & (r <= F.col("_upto")))
        return run.withColumn("_wanted", inside).where(F.size("_wanted") > 0).withColumn("_wanted", F.transform("_wanted", lambda r: r - (F.col("_upto") - F.col("_w"))))

    first = holding(rows.groupBy(*keys, "_c1").agg(F.sum("_w").alias("_w")), "_c1", keys, None).select(*keys, "_c1", "_wanted")
    at = [*keys, "_c1"]
    # Written once: only these few rows, those of the cells that hold the ranks, are read again.
    narrowed = cut_lineage(salted_join(rows, first, at, F.col("_x"), salts))
    second = holding(narrowed.groupBy(*at, "_c2", "_wanted").agg(F.sum("_w").alias("_w")), "_c2", at, first).select(*at, "_c2", "_wanted")
    at = [*at, "_c2"]
    narrowed = salted_join(narrowed.drop("_wanted"), second, at, F.col("_x"), salts)
    third = holding(narrowed.groupBy(*at, "_x", "_wanted").agg(F.sum("_w").alias("_w")), "_x", at, second)
    picked = third.select(*keys, F.explode("_wanted"), F.col("_x"))
    return picked.groupBy(*keys).agg(F.avg("_x").alias("median"))
