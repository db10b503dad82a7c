"""The first rows of each group against a plain sort, with hot and cold groups."""

import pytest
from pyspark.sql import functions as F

from tabspark.llm import queries, topn

def order():
    return [F.col("s").desc_nulls_last(), F.col("i").asc()]


def firsts(rows, n):
    groups = {}
    for g, s, i in rows:
        groups.setdefault(g, []).append((s is None, -(s or 0), i))
    return sorted(((g, i) for g, xs in groups.items() for _, _, i in sorted(xs)[:n]), key=repr)


@pytest.mark.parametrize("n", [1, 5])
def test_hot_and_cold_groups(spark, n):
    df = spark.range(0, 20_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 4001).cast("string"))).alias("g"),
        F.when(F.col("id") % 13 > 0, F.pmod(F.hash("id"), F.lit(40))).alias("s"), F.col("id").alias("i"),
    )
    got = topn.top_n(df, F.col("g"), order(), n, "who").collect()
    assert sorted(((r.who, r.i) for r in got), key=repr) == firsts([tuple(r) for r in df.collect()], n)


def test_repeated_rows_count(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 7 + [("A ", 1, 1)], "g string, s int, i int")
    assert topn.top_n(df, F.lower(F.trim("g")), order(), 5, "who").count() == 5


def test_edge_tables(spark):
    df = spark.createDataFrame([("a", 1, 1, 9, 8), ("x" * 50_000, None, 2, 9, 8)], "g string, s int, i int, _rank int, who int")
    out = topn.top_n(df, F.col("g"), order(), 5, "who")
    assert out.count() == 2 and set(out.columns) == {"g", "s", "i", "_rank", "who"} and {r._rank for r in out.collect()} == {9}
    assert topn.top_n(df.limit(0), F.col("g"), order(), 5, "who").count() == 0


def test_one_range_shuffle_for_heavy_groups(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").alias("s"), F.col("id").alias("i"))
    plan = topn.top_n(df, F.col("g"), order(), 3, "who")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "WindowGroupLimit" in plan


def test_query(spark):
    assert queries.p4_found(spark, "/root/testdata/sf0.001").count() > 0
