"""Joins of whole large tables: registered, and no row of either side left out."""

from collections import Counter

from tabspark.plans import reference

FOLDER = "/root/testdata/sf0.001"


def test_whole_tables_are_joined(spark):
    count = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").count()
    rows = {n: reference.QUERIES[n](spark, FOLDER).collect() for n in ("left_join_large", "right_join_large", "outer_join_large", "inner_join_multikey")}
    for name in ("left_join_large", "right_join_large", "outer_join_large"):
        assert len({r.l_orderkey for r in rows[name]}) == count("orders")
        assert len([r for r in rows[name] if r.l_linenumber is not None]) == count("lineitem")
        assert any(r.l_linenumber is None for r in rows[name])
    # Each line is paired with every line of its part and supplier, itself included, whatever its number.
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    assert len(rows["inner_join_multikey"]) == sum(n * n for n in Counter(map(tuple, lines)).values()) > len(lines)
