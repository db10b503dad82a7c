"""Changes between loads over every column of issue114, against a plain model."""

import re
from collections import Counter, defaultdict
from statistics import median

import duckdb

from tabspark.operators import profile
from tabspark.plans import problems
from tabspark.sources.memory import to_frame

FOLDER = "/root/testdata/sf0.001"
VOLUMES = ("oil_vol", "gas_vol")


def cells():
    """The cells of each column, load and feed, text without outer spaces, missing ones None."""
    read = duckdb.connect().execute(f"select * from '{FOLDER}/issue114.parquet'")
    names, kinds = [d[0] for d in read.description], [str(d[1]) for d in read.description]
    out = defaultdict(list)
    for row in read.fetchall():
        feed, load = row[names.index("feed_no")], row[names.index("load_no")]
        for c, v in zip(names, row, strict=True):
            if c not in ("feed_no", "load_no"):
                v = v.strip(" ") if isinstance(v, str) else v
                out[feed, c, load].append(None if v in ("", "NA") else v)
    return out, {c for c, kind in zip(names, kinds, strict=True) if kind in ("STRING", "VARCHAR")}


def as_number(v):
    if isinstance(v, (int, float)):
        return float(v)
    return float(v) if isinstance(v, str) and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", v) else None


def differences(now, then, ill, is_category):
    """ill: the ill-formed cells of both loads."""
    (a, b), (n, m) = ([v for v in x if v is not None] for x in (now, then)), (len(now), len(then))
    if abs((n - len(a)) * m - (m - len(b)) * n) * 10 > n * m:
        yield "null_share"
    if max(d := (len(set(a)), len(set(b)))) > 2 * min(d):
        yield "distinct_count"
    if a and b and abs(ill[0] * len(b) - ill[1] * len(a)) * 20 > len(a) * len(b):
        yield "pattern"
    if is_category:
        p, q = Counter(a), Counter(b)
        if a and b and sum(abs(p[v] * len(b) - q[v] * len(a)) for v in p | q) * 2 > len(a) * len(b):
            yield "distribution"
        return
    x, y = ([z for v in side if (z := as_number(v)) is not None] for side in (a, b))
    if any(z < 0 for z in x) != any(z < 0 for z in y) or x and y and (max(x) > 10 * max(y) or max(y) > 10 * max(x)):
        yield "value_range"
    if x and y and (median(x) > 2 * median(y) or median(y) > 2 * median(x)):
        yield "distribution"


def test_changes_of_every_column(spark):
    table, text = cells()
    ill = {(r.feed, r.column_name, r.load): r.n_ill for r in problems.p1_coverage(spark, FOLDER).collect()}
    expected, loads = [], defaultdict(list)
    for feed, c, load in table:
        loads[feed, c].append(load)
    for (feed, c), found in loads.items():
        found.sort()
        for then, now in zip(found, found[1:]):
            both = ill[feed, c, now], ill[feed, c, then]
            expected += [(feed, now, c, d) for d in differences(table[feed, c, now], table[feed, c, then], both, c in text and c not in VOLUMES)]
    got = problems.QUERIES["p1_changes"](spark, FOLDER)
    assert got.columns == ["feed_no", "load_no", "column_name", "finding"]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert len({c for _, _, c, _ in expected}) > 3


def test_induced_coverage_is_compared(spark, tmp_path):
    """A column without a stated form: of 200 codes, the second load has 20 broken ones, all of different shape."""
    broken = [f"?{'x-' * (n + 1)}{'Y#' * (20 - n)}" for n in range(20)]
    good = [f"A{n:03d}" for n in range(200)]
    rows = [(1, 1, v) for v in good] + [(1, 2, v) for v in good[:180] + broken] + [(1, 3, v) for v in good[:180] + broken]
    to_frame(spark, rows, "feed_no bigint, load_no bigint, facility_num string").write.parquet(str(tmp_path / "issue114.parquet"))
    found = problems.QUERIES["p1_changes"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 2, "facility_num", "pattern")]


def test_large_and_small_doubles_are_numbers(spark):
    """Spark prints these with an exponent."""
    values = {1: [1e7, 2.5e8, 1e-4], 2: [1.0, 2.0, 3.0], 3: [-1e-4, float("nan"), float("-inf")], 4: [float("inf")] * 3}
    df = to_frame(spark, [(1, n, v, f"{v:.1E}") for n, vs in values.items() for v in vs], "feed bigint, load bigint, x double, s string")
    p = profile.LoadProfile(df, "feed", "load", ["x", "s"])
    got = {r.load: (r.minimum, r.maximum) for r in p.summary().where("column_name = 'x'").collect()}
    assert got == {1: (1e-4, 2.5e8), 2: (1.0, 3.0), 3: (float("-inf"), -1e-4), 4: (float("inf"), float("inf"))}
    middle = {r.load: r.median for r in p.medians().where("column_name = 'x'").collect()}
    assert middle == {1: 1e7, 2: 2.0, 3: float("-inf"), 4: float("inf")}
    # Text cells are numbers by their form only.
    assert {r.load: (r.minimum, r.maximum) for r in p.summary().where("column_name = 's'").collect()}[1] == (None, None)
