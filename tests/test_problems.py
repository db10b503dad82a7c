"""The general data problem operators against plain models, and their edge cases."""

import datetime as dt
import random
import re
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.operators import orphans, profile, rejects, selection, timestamps
from tabspark.plans import problems
from tabspark.sources.memory import empty_frame, to_frame

# --- timestamps

UTC = dt.timezone.utc


def micros(*parts):
    return (dt.datetime(*parts, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


def instants(spark, pairs, **rules):
    df = to_frame(spark, [(i, *p) for i, p in enumerate(pairs)], "i int, s string, z string")
    out = timestamps.normalise_timestamps(df, "s", "z", timestamps.TimestampRules(**rules)).orderBy("i").collect()
    return [(r.epoch_us, r.ts_status) for r in out]


NOTATIONS = [
    ("2017-01-23 08:11:10", "America/Chicago", micros(2017, 1, 23, 14, 11, 10)),
    ("2017-01-23 08:11:10", None, micros(2017, 1, 23, 14, 11, 10)),
    ("  2008-10-14 ", "Europe/London", micros(2008, 10, 13, 23)),
    ("2014-01-10T13:46:06Z", "America/Denver", micros(2014, 1, 10, 13, 46, 6)),
    ("20101207T043208Z", None, micros(2010, 12, 7, 4, 32, 8)),
    ("27.09.2011 09:00", "UTC", micros(2011, 9, 27, 9)),
    ("1348117200", "Asia/Tokyo", 1348117200 * 10**6),
    ("1314218555157", None, 1314218555157 * 1000),
    ("Mon, 01 Apr 2024 10:11:01 -0500", "UTC", micros(2024, 4, 1, 15, 11, 1)),
    ("02/13/2022 12:07 AM", "UTC", micros(2022, 2, 13, 0, 7)),
    ("02/13/2022 12:07 PM", "UTC", micros(2022, 2, 13, 12, 7)),
    ("2/3/2022 5:07", "UTC", micros(2022, 2, 3, 5, 7)),
    ("2016-12-02T07:26:13+05:45", None, micros(2016, 12, 2, 1, 41, 13)),
    ("2008-10-07 15:52:45-0330", None, micros(2008, 10, 7, 19, 22, 45)),
    ("2014-02-20T22:01:00-07", None, micros(2014, 2, 21, 5, 1)),
    ("2021-01-23 22:13:01 Asia/Kolkata", "UTC", micros(2021, 1, 23, 16, 43, 1)),
    ("2016-05-13T19:00:00[America/New_York]", "UTC", micros(2016, 5, 13, 23)),
    ("2020-11-01 01:30:26 CST", "America/Phoenix", micros(2020, 11, 1, 7, 30, 26)),
    ("2020-11-01 01:30:26 CDT", "America/Phoenix", micros(2020, 11, 1, 6, 30, 26)),
    ("9 Mar 2016 09:09", "UTC", micros(2016, 3, 9, 9, 9)),
    ("Jul 21, 2018 8:32 AM", "UTC", micros(2018, 7, 21, 8, 32)),
    ("2017-05-06 08:21:14.901870", "UTC", micros(2017, 5, 6, 8, 21, 14, 901870)),
    ("2017-05-06 08:21:14.9", "UTC", micros(2017, 5, 6, 8, 21, 14, 900000)),
    ("2000-02-29", "UTC", micros(2000, 2, 29)),
]


def test_notations(spark):
    assert instants(spark, [c[:2] for c in NOTATIONS]) == [(c[2], "ok") for c in NOTATIONS]


def test_unresolved(spark):
    cases = {
        ("2015-03-08 02:30:00", "America/Chicago"): "never", ("2015-11-01 01:30:00", "America/Chicago"): "twice", ("2015-11-01 01:30:00", "America/Phoenix"): "ok",
        ("2019-02-29", None): "invalid", ("1900-02-29", None): "invalid", ("2021-13-05 10:00:00", None): "invalid", ("2011-06-15 25:10:00", None): "invalid",
        ("13/40/2009 10:00 AM", None): "invalid", ("01/02/2009 13:00 PM", None): "invalid", ("2017-07-01T12:61:00Z", None): "invalid", ("0000-01-01", None): "invalid",
        ("Tue, 01 Apr 2024 10:11:01 -0500", None): "invalid", ("2017-07-01T12:00:00+25:00", None): "invalid",
        ("not yet", None): "unreadable", ("12345", None): "unreadable", ("x" * 200_000, None): "unreadable", ("\u00012015", None): "unreadable",
        ("", None): "missing", ("   ", None): "missing", (None, "UTC"): "missing",
        ("2015-01-01 10:00:00", "Mars/Base"): "unknown_zone", ("2015-01-01 10:00:00 XYZ", "UTC"): "unknown_zone",
    }
    got = instants(spark, list(cases))
    assert [s for _, s in got] == list(cases.values())
    assert all((us is None) == (s != "ok") for us, s in got)


def test_local_times_against_the_zone_table(spark):
    rng = random.Random(3)
    zones = ["America/Chicago", "Europe/Berlin", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "Pacific/Apia", "EST", "HST"]
    pairs, expected = [], []
    for _ in range(3000):
        zone = rng.choice(zones)
        wall = dt.datetime(rng.choice([1790, 1879, 1880, 1881, 1919, 1945, 2108, 2109, 2110, 2400, 9998, *range(1970, 2040)]), rng.choice([3, 4, 10, 11]), rng.randrange(1, 31), rng.randrange(4), rng.randrange(60))
        fits = set()
        for fold in (0, 1):
            at = wall.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=fold).astimezone(UTC)
            if at.astimezone(zoneinfo.ZoneInfo(zone)).replace(tzinfo=None) == wall:
                fits.add(at)
        pairs.append((wall.isoformat(), zone))
        expected.append((fits.pop() - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1) if len(fits) == 1 else None)
    assert [us for us, _ in instants(spark, pairs)] == expected


def test_days_from_civil():
    days = [dt.date(1, 1, 1), dt.date(1582, 10, 15), dt.date(1969, 12, 31), dt.date(2000, 2, 29), dt.date(2100, 3, 1), dt.date(9999, 12, 31)]
    got = timestamps.days_from_civil(*(np.array([getattr(d, part) for d in days]) for part in ("year", "month", "day")))
    assert got.tolist() == [d.toordinal() - dt.date(1970, 1, 1).toordinal() for d in days]


def test_timestamps_edge_tables(spark):
    df = to_frame(spark, [("2015-01-01", 1, 7, 9), ("2015-01-01", 1, 7, 9)], "s string, epoch_us int, _ts int, ts_status int")
    out = timestamps.normalise_timestamps(df, "s", None)
    assert out.count() == 2 and set(out.columns) == {"s", "epoch_us", "_ts", "ts_status"} and out.first()._ts == 7
    assert timestamps.normalise_timestamps(df.limit(0), "s", None).count() == 0
    with pytest.raises(SchemaError):
        timestamps.normalise_timestamps(df, "nothing", None)


# --- exact medians and profiles


def test_medians(spark):
    rng = random.Random(1)
    groups = {
        "a": [rng.lognormvariate(0, 5) * rng.choice([-1, 1]) for _ in range(1001)], "b": [1.0 + i * 2**-50 for i in range(10)], "c": [0.0, -0.0, 5.0],
        "d": [3.0], "e": [7.0] * 500 + [8.0] * 500, "f": [-1e300, 1e300], "g": [1e-310, 5e-324, 0.0], None: [2.0, 4.0],
    }
    rows = [(g, x, 1) for g, xs in groups.items() for x in xs] + [("h", None, 1), ("d", 100.0, 0)]
    df = to_frame(spark, rows, "g string, x double, w bigint")
    got = {r.g: r.median for r in selection.exact_medians(df, ["g"], "x", "w").collect()}
    assert got == {g: pytest.approx(float(np.median(xs)), rel=1e-15) for g, xs in groups.items()}
    assert selection.exact_medians(df.limit(0), ["g"], "x", "w").count() == 0


def test_medians_with_weights(spark):
    df = to_frame(spark, [("a", float(x), x) for x in range(1, 50)] + [("a", 3.0, 4)], "g string, x double, w bigint")
    values = [float(x) for x in range(1, 50) for _ in range(x)] + [3.0] * 4
    assert selection.exact_medians(df, ["g"], "x", "w").first().median == np.median(values)


def changes(spark, cases, numeric=("c",), categories=()):
    """Findings of each case; a case is the loads of a feed of its own."""
    rows = [(feed, n, v) for feed, loads in enumerate(cases) for n, values in enumerate(loads, 1) for v in values]
    df = to_frame(spark, rows, "feed bigint, load bigint, c string")
    found = profile.LoadProfile(df, "feed", "load", ["c"], list(numeric)).changes(list(categories)).collect()
    return [sorted((r.load, r.finding) for r in found if r.feed == feed) for feed in range(len(cases))]


def test_changes_between_loads(spark):
    same = [str(n) for n in range(100)]
    shrunk = [(3, "distinct_count"), (3, "distribution")]
    cases = [
        ([same, same], []),
        ([same, same[:90] + [" NA "] * 10], []),  # exactly a tenth is not over it
        ([same, same[:88] + ["NA", "", None, "  "] * 3], [(2, "null_share")]),
        ([same, same[:94] + ["x"] * 6], [(2, "pattern")]),
        ([same, same[:95] + ["x"] * 5], []),
        ([same, same[1:] + ["-1"]], [(2, "value_range")]),
        ([same, same[1:] + ["991"]], [(2, "value_range")]),
        ([same, same[1:] + ["990"]], []),
        ([same, [str(n * 3) for n in range(100)]], [(2, "distribution")]),
        ([same, same, same[:49]], shrunk),
        ([same, [], same], []),
        ([["NA"] * 5, same], [(2, "distinct_count"), (2, "null_share")]),
    ]
    assert changes(spark, [c for c, _ in cases]) == [e for _, e in cases]


def test_category_distance(spark):
    first = ["AA"] * 50 + ["BB"] * 50
    cases = [
        ([first, ["AA"] * 75 + ["BB"] * 25], []),  # exactly a quarter is not above it
        ([first, ["AA"] * 76 + ["BB"] * 24], [(2, "distribution")]),
        ([first, ["CC"] * 100], [(2, "distribution")]),
        ([first, [None] * 100], [(2, "distinct_count"), (2, "null_share")]),
    ]
    assert changes(spark, [c for c, _ in cases], (), ("c",)) == [e for _, e in cases]


def induced(spark, columns, loads=1):
    """The expressions of each column whose values are a list, the same in all loads, or a list for each load."""
    rows = [(load, c, v) for c, values in columns.items() for load in range(loads) for v in (values[load] if isinstance(values[0], list) else values)]
    df = to_frame(spark, rows, "load int, column_name string, value string").withColumn("shape", profile.shape_of(F.col("value")))
    shapes = df.groupBy("load", "column_name", "shape").agg(F.count_distinct("value").alias("d"), F.count(F.lit(1)).alias("n"))
    found = profile.induce_expressions(shapes, ["load"]).where("expression is not null").select("column_name", "expression").distinct().collect()
    return {c: sorted(r.expression for r in found if r.column_name == c) for c in columns}


def test_expressions_by_description_length(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(1, 40)]
    whole, real = [str(n) for n in range(300)], [f"{rng.randrange(5000)}.{rng.randrange(10)}" for _ in range(300)]
    names = [" ".join("".join(rng.choice("ABCdefg") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    got = induced(spark, {
        "code": [f"{n:05d}" for n in range(300)] + ["n/a?"], "n": whole + real + ["-5", "1.2.3", "~4", "+5", "see note"], "w": words, "pair": ["AB", "CD", "XY"] * 50 + ["LONGER"],
        "date": [f"{y}-{m:02d}-01" for y in range(2000, 2020) for m in range(1, 13)], "names": [*names, "a,b", "x_9"], "none": [None, None], "odd": ["a/b.c|d", "1+2=3", "{x}", "#%&", "~!@$"],
    })
    number, union = r"\A-?[0-9]+(\.[0-9]+)?\z", r"\A[A-Za-z\s]+\z"
    assert got["code"] == [r"\A[0-9][0-9][0-9][0-9][0-9]\z"] and got["n"] == [number] and got["pair"] == [r"\A[A-Z][A-Z]\z"]
    assert got["w"] == [r"\A[a-z]+\z"] and got["date"] == [r"\A[0-9][0-9][0-9][0-9]\-[0-9][0-9]\-[0-9][0-9]\z"]
    assert len(got["names"]) == 1 and all(re.fullmatch(e[2:-2], n) for e in got["names"] for n in names) and not re.fullmatch(got["names"][0][2:-2], "a,b"), union
    assert got["none"] == []
    assert profile.induce_expressions(to_frame(spark, [], "load int, column_name string, shape string, d bigint, n bigint"), ["load"]).count() == 0


def test_a_minority_of_bad_loads_bends_nothing(spark):
    good, bad = [f"{n}.5" for n in range(200)], [f"{n}.5 bbl" for n in range(200)]
    rare = [f"{n}.5" for n in range(200)] + ["tr"]
    assert induced(spark, {"c": [good, bad, rare, rare, rare]}, 5)["c"] == [r"\A-?[0-9]+(\.[0-9]+)?\z"]
    assert induced(spark, {"c": [good, bad, bad]}, 3)["c"] == [r"\A[0-9]+\.[0-9]+\s+[a-z]+\z"]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_induced_expressions_are_the_stated_forms(spark, scale):
    p = problems._three_columns(spark, f"/root/testdata/{scale}")
    taken = p.values.where("value is not null").join(p.expressions(), ["column_name", "shape"]).select("column_name", "value", F.col("expression").isNotNull().alias("taken"), "expression")
    stated = F.when(F.col("column_name") == "well_status", F.col("value").rlike(r"\A[A-Z]{2}\z")).otherwise(F.col("value").rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"))
    assert taken.count() > 300 and taken.where((F.col("taken") != stated) | F.expr("taken and not value rlike expression")).count() == 0


def test_every_induced_expression_covers_its_shape(spark):
    odd = ["5", "-5.25", "Word", "a b", "a\tb", "é9", "x|y", "(1)", "A.B*C", "[z]", "\\", "+5", "9+9", "数字 12"]
    df = to_frame(spark, [(v,) for v in odd], "value string")
    shape = profile.shape_of(F.col("value"))
    forms = {"tight": shape, "loose": profile.loosened(shape), "general": profile.generalised(profile.loosened(shape))}
    got = df.select("value", *[profile.as_expression(c).alias(n) for n, c in forms.items()], profile.as_class(profile._symbols(shape)).alias("class"))
    assert [r.value for r in got.where("not (value rlike tight and value rlike loose and value rlike general and value rlike class)").collect()] == []


def test_profile_edge_tables(spark):
    rows = [(1, 1, "5", 1.5, None), (1, 1, "5", 1.5, None), (None, None, None, None, None), (1, 2, "x" * 100_000, -2.0, None)]
    df = to_frame(spark, rows, "feed bigint, load bigint, value string, n double, k0 string")
    p = profile.LoadProfile(df, "feed", "load", ["value", "n", "k0"])
    got = {(r.feed, r.load, r.column_name): r for r in p.summary().collect()}
    assert len(got) == 9 and got[1, 1, "value"].n_rows == 2 and got[1, 1, "value"].n_distinct == 1 and got[1, 2, "n"].has_negative
    assert got[None, None, "k0"].n_missing == 1 and got[1, 1, "k0"].n_missing == 2
    empty = profile.LoadProfile(df.limit(0), "feed", "load", ["value"])
    assert empty.summary().count() == empty.changes([]).count() == 0
    with pytest.raises(SchemaError):
        profile.LoadProfile(df, "feed", "load", ["other"])


# --- records


LAYOUT = {"f": [("a", "text"), ("n", "int"), ("d", "double")], "one": [("t", "text")]}


def plain_fields(record):
    if record.endswith("\r"):
        record = record[:-1]
    at, out = 0, []
    while True:
        if record[at : at + 1] == '"':
            end = at + 1
            while end < len(record) and not (record[end] == '"' and record[end + 1 : end + 2] in ("", ",")):
                end += 1
            if end >= len(record):
                return None
            out.append(record[at + 1 : end].replace('""', '"'))
            at = end + 2
            if at > len(record):
                return out
        else:
            end = record.find(",", at)
            end = len(record) if end < 0 else end
            if '"' in record[at:end]:
                return None
            out.append(record[at:end].strip(" "))
            at = end + 1
            if at > len(record):
                return out


def plain_reason(record, kinds):
    fields = plain_fields(record or "")
    if fields is None:
        return "quoting", None
    if len(fields) != len(kinds):
        return "column_count", None
    forms = {"int": r"-?[0-9]+(\.0)?", "double": r"-?[0-9]+(\.[0-9]+)?"}
    for text, kind in zip(fields, kinds, strict=True):
        if kind in forms and text not in ("", "NA") and not re.fullmatch(forms[kind], text.replace(",", "") if kind == "double" else text):
            return "bad_value", None
    return None, fields


def split(spark, pairs, partitions=1):
    df = to_frame(spark, [(i, *p) for i, p in enumerate(pairs)], "i int, file string, rec string").repartition(partitions, "i")
    return {r.i: (r.reason, r.fields) for r in rejects.split_records(df, "rec", "file", LAYOUT).collect()}


def test_records_against_a_plain_reader(spark):
    rng = random.Random(9)
    records = ["".join(rng.choice('a1,"" \n.-') for _ in range(rng.randrange(18))) for _ in range(3000)]
    records += [",".join(rng.choice(['"a"', '"a,b"', "1", "NA", "", ' 2 ', '"3"', "-4.0", '"1,000.5"', '"x""y"', '"b"c"']) for _ in range(3)) for _ in range(3000)]
    records += ["", "\r", '"', '""', ",,", "é,1,2", '"数, 字",1,2\r', None]
    got = split(spark, [("f", r) for r in records], 3)
    kinds = [k for _, k in LAYOUT["f"]]
    for i, record in enumerate(records):
        assert got[i] == plain_reason(record, kinds), record


def test_records_edge_tables(spark):
    got = split(spark, [("one", ""), ("one", None), ("zzz", "a"), (None, "a"), ("one", '"' + "x," * 400_000 + '"'), ("one", "a," * 200_000), ("one", '"a' + '"b' * 100_000)])
    assert [got[i][0] for i in range(7)] == [None, None, "unknown_file", "unknown_file", None, "column_count", "quoting"]
    assert got[0][1] == [""] and len(got[4][1][0]) == 800_000
    df = to_frame(spark, [("f", "a,1,2", 1, "z"), ("f", "a,1,2", 1, "z")], "file string, rec string, _record int, reason string")
    out = rejects.split_records(df, "rec", "file", LAYOUT)
    assert out.count() == 2 and out.columns == ["file", "rec", "_record", "reason", "fields"]
    assert rejects.split_records(df.limit(0), "rec", "file", LAYOUT).count() == 0


def test_typed_rows(spark):
    df = to_frame(spark, [(1, "f", '"x, ""y""", 5.0 ,"1,000.5"'), (2, "f", "NA,,NA"), (3, "f", "t,99999999999999999999,-2"), (4, "f", "bad")], "n int, file string, rec string")
    out = rejects.valid_rows(rejects.split_records(df, "rec", "file", LAYOUT), "file", "f", LAYOUT, ["n"])
    assert out.dtypes == [("n", "int"), ("a", "string"), ("_n", "bigint"), ("d", "double")]
    assert sorted(map(tuple, out.collect())) == [(1, 'x, "y"', 5, 1000.5), (2, "NA", None, None), (3, "t", None, -2.0)]


# --- orphans


NAMES = orphans.Names("ref", "at", "id", "b", "e")
REFS, PARENTS = "k bigint, ref bigint, at timestamp", "id bigint, b timestamp, e timestamp"


def plain_causes(refs, parents):
    out = []
    for k, ref, at in refs:
        if ref is None:
            continue
        rows = [(b, e) for i, b, e in parents if i == ref]
        if at is not None and any(b is not None and b <= at and (e is None or e > at) for b, e in rows):
            cause = None
        elif not rows:
            cause = "missing"
        elif at is not None and all(b is None or b > at for b, e in rows):
            cause = "later"
        else:
            cause = "deleted"
        out.append((k, cause))
    return sorted(out, key=repr)


def random_links(seed, n=800, hot=False):
    rng = random.Random(seed)
    when = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 12), minutes=rng.choice([0, 0, 30]))
    parents = [(rng.randrange(15) if rng.random() > 0.03 else None, when(), when() if rng.random() < 0.6 else None) for _ in range(40)]
    refs = [(k, (3 if hot and rng.random() < 0.7 else rng.randrange(20)) if rng.random() > 0.05 else None, when() if rng.random() > 0.03 else None) for k in range(n)]
    return refs + refs[:20], parents + parents[:5]


@pytest.mark.parametrize("hot", [False, True])
def test_orphans_against_a_plain_model(spark, hot):
    refs, parents = random_links(11, hot=hot)
    got = orphans.classify(to_frame(spark, refs, REFS), to_frame(spark, parents, PARENTS), NAMES).collect()
    assert sorted(((r.k, r.cause) for r in got), key=repr) == plain_causes(refs, parents)


def test_increments_reach_the_same_state(spark, tmp_path):
    refs, parents = random_links(12, 300)
    parents = list({(i, b): (i, b, e) for i, b, e in parents}.values())
    store = orphans.OrphanStore(spark, str(tmp_path / "s"), NAMES, to_frame(spark, [], REFS).schema, to_frame(spark, [], PARENTS).schema, 4)
    for n in range(3):
        early = [(i, b, None) for i, b, e in parents[n::3] if e is not None]  # first without their end
        store.deliver(to_frame(spark, refs[n::3], REFS), to_frame(spark, early, PARENTS))
        store.deliver(to_frame(spark, [], REFS), to_frame(spark, parents[n::3], PARENTS))
    waiting = [(k, c) for k, c in plain_causes(refs, parents) if c]
    assert sorted(((r.k, r.cause) for r in store.waiting().collect()), key=repr) == waiting


def test_a_delivery_writes_only_what_it_touches(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    refs, parents = (lambda *r: to_frame(spark, r, REFS)), (lambda *r: to_frame(spark, r, PARENTS))
    open_store = lambda: orphans.OrphanStore(spark, str(tmp_path / "s"), NAMES, refs().schema, parents().schema, 64)
    store = open_store()
    store.deliver(refs(*[(k, k, day(5)) for k in range(500)]), parents())
    first = dict(store.log["waiting"])
    assert len(first) == 64 and set(first.values()) == {1}
    store.deliver(refs((1000, 7, day(6))), parents((7, day(1), day(6))))
    changed = [b for b, n in store.log["waiting"].items() if n == 2]
    assert len(changed) == 1 and {b for b, n in store.log["waiting"].items() if n == 1} == set(first) - set(changed)
    in_bucket = spark.read.parquet(str(tmp_path / "s" / "waiting" / "1" / changed[0])).count()
    assert spark.read.parquet(str(tmp_path / "s" / "waiting" / "2")).count() == in_bucket  # one resolved, one new
    assert spark.read.parquet(str(tmp_path / "s" / "refs" / "2")).count() == spark.read.parquet(str(tmp_path / "s" / "parents" / "2")).count() == 1
    # What a failed delivery left is not part of the state.
    (tmp_path / "s" / "waiting" / "3").mkdir()
    assert open_store().waiting().count() == store.waiting().count() == 500
    assert {r.k: r.cause for r in store.waiting().where("ref = 7").collect()} == {1000: "deleted"}


def test_orphans_edge_tables(spark):
    refs, parents = to_frame(spark, [(1, 5, dt.datetime(2020, 1, 1))], REFS), to_frame(spark, [], PARENTS)
    assert [r.cause for r in orphans.classify(refs, parents, NAMES).collect()] == ["missing"]
    assert orphans.classify(refs.limit(0), parents, NAMES).count() == 0
    odd = refs.selectExpr("k as kind", "ref", "at", "k as alive", "'x' as cause")
    out = orphans.classify(odd, parents, NAMES)
    assert out.columns == ["kind", "ref", "at", "alive", "cause"] and out.first().cause == "missing"
    with pytest.raises(SchemaError):
        orphans.classify(refs.drop("at"), parents, NAMES)


# --- queries


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_queries_run(spark, name):
    folder = "/root/testdata/sf0.001"
    assert problems.QUERIES[name](spark, folder).count() >= 0
