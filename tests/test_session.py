"""The shared folder, cut lineage, and the driver's entry file."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabspark import session
from tabspark.errors import SchemaError
from tabspark.sources.memory import to_frame


def fake(master, checkpoint=None, conf=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf or default))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(SchemaError):
            session.shared_folder(fake(master))
        assert session.shared_folder(fake(master, conf="hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(fake("yarn", "file:/a/b")) == "file:/a/b"
    assert os.path.isdir(session.shared_folder(fake("local[2]")))


def test_cut_lineage_keeps_rows_names_and_types(spark):
    df = to_frame(spark, [(1, 2, "a", None), (None, None, None, [1])], "x int, X int, `` string, `a.b` array<int>")
    cut = session.cut_lineage(df)
    assert cut.schema == df.schema and sorted(cut.collect(), key=str) == sorted(df.collect(), key=str)
    assert "parquet" in cut._jdf.queryExecution().toString().lower()
    assert session.cut_lineage(df.limit(0)).count() == 0
    odd = spark.range(2).select(F.lit(None).alias("nothing"), "id")
    assert session.cut_lineage(odd).count() == 2
    pruned = cut.select("`a.b`")._jdf.queryExecution().executedPlan().toString()
    assert "c3" in pruned and "c2" not in pruned


def test_written_rows_are_removed(spark, tmp_path):
    code = """
import sys; sys.path.insert(0, {repo!r})
from tabspark.session import build_session, cut_lineage
spark = build_session("local[1]", "gone", **{{"spark.checkpoint.dir": {folder!r}}})
assert cut_lineage(spark.range(5)).count() == 5
import os; print("WRITTEN", sum(x.startswith("rows-") for _, names, _ in os.walk({folder!r}) for x in names))
spark.stop()
"""
    folder = str(tmp_path / "shared")
    run = subprocess.run([sys.executable, "-c", code.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=folder)], capture_output=True, text=True, timeout=120)
    assert "WRITTEN 1" in run.stdout, run.stderr[-500:]
    assert not [x for _, names, _ in os.walk(folder) for x in names if x.startswith("rows-")]
