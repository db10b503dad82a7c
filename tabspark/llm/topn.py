"""The first N rows of every group, whatever the sizes of the groups.

Hot and cold groups part ways: exact counts send heavy groups to a range sort by group and salt, whose parts are cut to N
rows before the rest of a group meets, and light groups to an ordinary window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.session import fresh

MOST_HEAVY = 1000


def top_n(df: DataFrame, group: Column, order: list[Column], n: int, name: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each ``group`` in the given order, all if it has fewer, with the group as column ``name``.

    ``order`` should decide every tie; rows equal in all of it are kept in an arbitrary choice of the ``n`` places. Rows
    with a null group form a group; repeated rows count as rows; an empty table gives an empty one; an existing column
    ``name`` is replaced. A group is heavy if it holds more than a thousandth of all rows, so there are never more than a
    thousand heavy groups, and their names can be broadcast.
    """
    kept = [c for c in df.columns if c != name]
    rank, salt, total, many = fresh([*kept, name], "_rank", "_salt", "_total", "_many")
    rows = df.withColumn(name, group)
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias(many))
    heavy = counts.where(F.col(many) * MOST_HEAVY > counts.agg(F.sum(many)).scalar())
    hot = F.broadcast(heavy.select(F.col(name).alias(total)))
    is_hot = F.col(name).eqNullSafe(F.col(total))
    whole = Window.partitionBy(name).orderBy(*order)
    first = lambda part, window: part.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n).drop(rank)

    light = first(rows.join(hot, is_hot, "left_anti"), whole)
    spread = rows.join(hot, is_hot, "left_semi").withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in kept]), F.lit(salts)))
    # A range partitioning on group and salt is one the window below can use: no second shuffle.
    parts = first(spread.repartitionByRange(F.col(name), F.col(salt)), Window.partitionBy(name, salt).orderBy(*order)).drop(salt)
    return light.unionByName(first(parts, whole))
