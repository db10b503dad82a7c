"""File streams, windows over event time, and orphans kept up over micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tabspark.functions import parsing as P
from tabspark.operators import orphans
from tabspark.sources import infer, readers
from tabspark.sources.memory import to_frame
from tabspark.streaming import tables


def test_stream_of_rows_to_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, body in enumerate(["k,v\n1,a\nbad,b\n", "k,v\n3,c\n"]):
        (tmp_path / "in" / f"{n}.csv").write_text(body)
    spec = infer.table_spec({"k": P.INT, "v": P.TEXT})
    stream = tables.stream_table(spark, str(tmp_path / "in"), spec, files_per_batch=1)
    doubled = stream.withColumn("k", F.col("k") * 2)
    write = lambda: [tables.stream_to_dsv(doubled, str(tmp_path / f"out{h}"), str(tmp_path / f"cp{h}"), header=h).awaitTermination() for h in (True, False)]
    write()
    (tmp_path / "in" / "2.csv").write_text("k,v\n5,e\n")
    write()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "outFalse")).collect()) == ["10,e", "2,a", "6,c"]
    files = [p.read_text().splitlines() for p in (tmp_path / "outTrue").rglob("part-*")]
    assert all(f[0] == "k,v" for f in files) and sorted(x for f in files for x in f[1:]) == ["10,e", "2,a", "6,c"]
    assert sorted(r.k for r in readers.read_table(spark, str(tmp_path / "outTrue"), spec).collect()) == [2, 6, 10]


def test_stream_places_limits_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sizes, at = [3, 5, 1], 0
    for n, size in enumerate(sizes):
        (tmp_path / "in" / f"{n}.csv").write_text("k\n" + "".join(f"{k}\n" for k in range(at, at + size)))
        os.utime(tmp_path / "in" / f"{n}.csv", (n, n))
        at += size
    seen = {}
    stream = lambda: tables.stream_table(spark, str(tmp_path / "in"), infer.table_spec({"k": P.INT}), files_per_batch=1, placed=True)
    keep = lambda name: lambda df, n: seen.setdefault(name, {}).__setitem__(n, sorted(map(tuple, df.collect())))
    tables.stream_placed(stream(), str(tmp_path / "a"), keep("chunks"), size=4).awaitTermination()
    assert sum(seen["chunks"].values(), []) == [(k, k, k // 4) for k in range(9)] and len(seen["chunks"]) == 3
    tables.stream_placed(stream(), str(tmp_path / "b"), keep("middle"), 2, 7).awaitTermination()
    assert sum(seen["middle"].values(), []) == [(k, k) for k in range(2, 7)]


def test_maybe_and_either_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k\n1\nx\n")
    spec, seen = infer.table_spec({"k": P.INT}), []
    for policy in ("maybe", "either"):
        stream = tables.stream_table(spark, str(tmp_path / "in"), spec, policy)
        tables.stream_chunks(stream, str(tmp_path / policy), lambda df, n: seen.append(sorted(map(str, (r.k for r in df.collect()))))).awaitTermination()
    assert seen == [["1", "None"], ["Row(value=1, raw=None)", "Row(value=None, raw='x')"]]


def test_event_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), k, float(m)) for m in range(10) for k in ("a", "b")]
    to_frame(spark, rows, "t timestamp, k string, v double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "e"))
    out = tables.stream_events(stream, "t", "1 minute", "5 minutes", ["k"], "v")
    out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.window_start.minute, r.k, r.n, r.total) for r in spark.table("windows").collect())
    assert got == [(0, "a", 5, 10.0), (0, "b", 5, 10.0), (5, "a", 5, 35.0), (5, "b", 5, 35.0)]


def test_orphan_stream(spark, tmp_path):
    names = orphans.Names("ref", "at", "id", "b", "e")
    day = lambda n: dt.datetime(2024, 1, n)
    refs = lambda *r: to_frame(spark, r, "k string, ref bigint, at timestamp")
    parents = lambda *r: to_frame(spark, r, "id bigint, b timestamp, e timestamp")
    opened = lambda: tables.OrphanStream(orphans.OrphanStore(spark, str(tmp_path / "s"), names, refs().schema, parents().schema, 8))
    waiting = lambda s: {r.k: r.cause for r in s.store.waiting().collect()}
    stream = opened()
    assert waiting(stream) == {}
    stream.deliver(refs(("x", 1, day(5)), ("y", 2, day(5)), ("z", None, day(5))), 0)
    assert waiting(stream) == {"x": "missing", "y": "missing"}
    stream.deliver_parents(parents((1, day(1), None), (2, day(7), None)))
    assert waiting(stream) == {"y": "later"}
    again = opened()  # after a restart
    assert waiting(again) == {"y": "later"} and not again.deliver(refs(("x", 1, day(5))), 0) and waiting(again) == {"y": "later"}
    again.deliver_parents(parents((1, day(1), day(3))))
    again.deliver(refs(("w", 2, day(8))), 1)
    assert waiting(again) == {"x": "deleted", "y": "later"}
    assert sorted(map(tuple, again.store.snapshot("t").collect())) == [("t", "2024-01", "deleted", 1), ("t", "2024-01", "later", 1)]
