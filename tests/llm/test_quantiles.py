"""Rank errors of summaries against sorted data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.llm import quantiles as Q
from tabspark.llm import queries

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def off_by(values, rank, value):
    ordered = np.sort(values)
    low, high = np.searchsorted(ordered, value, "left") + 1, np.searchsorted(ordered, value, "right")
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("kind", ["uniform", "ties", "sorted", "heavy"])
def test_merged_summaries_stay_within_the_error(kind):
    rng = np.random.default_rng(2)
    n, error = 60_000, 0.01
    data = {"uniform": rng.random(n), "ties": rng.integers(0, 7, n).astype(float), "sorted": np.arange(n, dtype=float), "heavy": rng.pareto(0.5, n)}[kind]
    parts = [Q.compress(Q.exact_summary(x), error) for x in np.array_split(data, 37)]
    middle = [Q.merge_all(parts[i : i + 8], error) for i in range(0, 37, 8)]
    whole = Q.merge_all(middle, error)
    assert whole.n == n and whole.uncertainty <= error * n and len(whole.values) < 3000
    for share in SHARES:
        value, low, high = Q.answer(whole, share)
        rank = max(1, math.ceil(share * n))
        assert off_by(data, rank, value) <= max(abs(low - rank), abs(high - rank)) <= error * n + 1


def test_bounds_of_ranks_are_true():
    rng = random.Random(1)
    data = [[rng.randrange(30) for _ in range(rng.randrange(1, 50))] for _ in range(9)]
    s = Q.merge_all([Q.compress(Q.exact_summary(np.array(x, float)), 0.1) for x in data], 0.1)
    ordered = np.sort(np.concatenate(data))
    for v, low, high in zip(s.values, s.low, s.high, strict=True):
        first, last = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        assert low <= last and high >= first and low <= high
    assert (s.values[0], s.values[-1]) == (ordered[0], ordered[-1])


def test_days_combine_to_the_whole(spark):
    rows = spark.range(0, 40_000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("g"),
        (F.col("id") % 20).alias("day"), (F.xxhash64("id") % 1000 / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.pmod(F.hash("id"), F.lit(9))).alias("y"),
    )
    daily = Q.combine(Q.summarise(rows, ["g", "day"], ["x", "y"], 0.01), ["g", "day"], 0.01)
    found = Q.percentiles(Q.combine(daily, ["g"], 0.01), ["g"], SHARES).collect()
    again = Q.percentiles(Q.combine(daily, ["g"], 0.01), ["g"], SHARES).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    data = {}
    for r in rows.collect():
        for m in ("x", "y"):
            if r[m] is not None:
                data.setdefault((r.g, m), []).append(float(r[m]))
    assert len(found) == len(data) * len(SHARES)
    for r in found:
        values = data[r.g, r.measure]
        rank = max(1, math.ceil(r["share"] * len(values) - 1e-9))
        assert r.n == len(values) and off_by(values, rank, r.value) <= r.rank_error <= 0.01 * r.n + 1


def test_edge_tables(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", float("nan"), 2), ("b", -0.0, 3), ("b", float("inf"), 4)], "g string, x double, _part int")
    one = Q.summarise(df, ["g"], ["x"])
    assert [(r.g, r.n, r["values"]) for r in one.collect() if r.n] == [("b", 2, [0.0, float("inf")])] or one.agg(F.sum("n")).first()[0] == 2
    assert Q.combine(Q.summarise(df.limit(0), ["g"], ["x"]), ["g"]).count() == 0
    assert Q.combine(Q.summarise(df, [], ["x"]), []).first().n == 2
    for groups, measures in ((["nothing"], ["x"]), (["g"], ["nothing"])):
        with pytest.raises(SchemaError):
            Q.summarise(df, groups, measures)
    with pytest.raises(SchemaError):
        Q.summarise(df.withColumnRenamed("g", "part"), ["part"], ["x"])


def test_many_rows_in_one_partition(spark):
    rows = spark.range(0, 400_000, numPartitions=1).select((F.xxhash64("id") % 100_000).alias("x"))
    s = Q.combine(Q.summarise(rows, [], ["x"], 0.01), [], 0.01)
    values = [r.x for r in rows.collect()]
    for r in Q.percentiles(s, [], [0.1, 0.5, 0.999]).collect():
        rank = math.ceil(r["share"] * 400_000 - 1e-9)
        assert off_by(values, rank, r.value) <= r.rank_error <= 4001 and len(s.first()["values"]) < 2000


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.p2_percentiles(spark, folder).count() > 0 and queries.p2_daily(spark, folder).count() > 0
