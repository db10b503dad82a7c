"""Shares, caps, order and budget of mixtures."""

from collections import Counter

import pytest

from tabspark.llm import queries
from tabspark.llm.mixture import Target, level_for, mix_sources, read_targets


def corpus(spark, sizes):
    rows = [(n * 1000 + i, "word " * (i % 7 + 1), s) for n, (s, k) in enumerate(sizes.items()) for i in range(k)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


TARGETS = {"big": Target(0.5, 1), "small": Target(0.3, 2), "tiny": Target(0.1, 3), "none": Target(0.1, 5)}


def test_level():
    assert level_for(10, {"a": 100, "b": 100}, {"a": Target(0.5, 1), "b": Target(0.5, 1)}) == pytest.approx(10)
    assert level_for(150, {"a": 100, "b": 25}, {"a": Target(0.5, 2), "b": Target(0.5, 1)}) == pytest.approx(250)
    assert level_for(10**9, {"a": 100}, {"a": Target(0.5, 2)}) == pytest.approx(400)
    assert level_for(5, {}, {}) == 0


def test_shares_and_caps(spark):
    mixture, report = mix_sources(corpus(spark, {"big": 600, "small": 60, "tiny": 20, "other": 50, None: 5}), "doc_id", "text", "source", TARGETS, 2500, parts=16)
    rows, facts = mixture.collect(), {r.source: r for r in report.collect()}
    assert set(facts) == set(TARGETS) and facts["none"].mixed_tokens == 0 and facts["none"].available_tokens == 0
    total = sum(r.n_tokens for r in rows)
    assert 2490 <= total <= 2500
    for name in ("small", "tiny"):  # used up: all of it, as often as it may be
        assert facts[name].mixed_tokens == facts[name].available_tokens * TARGETS[name].repeats
    uses = Counter((r.source, r.doc_id) for r in rows)
    assert max(uses.values()) <= 3 and all(n <= TARGETS[s].repeats for (s, _), n in uses.items())
    assert sum(f.actual_share for f in facts.values()) == pytest.approx(1)
    assert [r.running_tokens for r in rows] == list(__import__("itertools").accumulate(r.n_tokens for r in rows))
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)


def test_default_budget_meets_all_shares(spark):
    """All but the source without documents, within one document."""
    mixture, report = mix_sources(corpus(spark, {"big": 600, "small": 60, "tiny": 20}), "doc_id", "text", "source", TARGETS)
    facts = {r.source: r for r in report.collect()}
    whole = sum(f.mixed_tokens for f in facts.values())
    assert whole > 500 and facts["none"].mixed_tokens == 0
    for name in ("big", "small", "tiny"):
        assert abs(facts[name].mixed_tokens - whole * TARGETS[name].share / 0.9) <= 16
    assert any(f.mixed_tokens >= f.available_tokens * f.max_repeats - 16 for f in facts.values() if f.available_tokens)


def test_exact_shares_within_a_document(spark):
    targets = {"big": Target(0.75, 1), "small": Target(0.25, 4)}
    _, report = mix_sources(corpus(spark, {"big": 500, "small": 80}), "doc_id", "text", "source", targets, budget=1200, parts=8)
    facts = {r.source: r for r in report.collect()}
    assert facts["big"].mixed_tokens == pytest.approx(900, abs=16) and facts["small"].mixed_tokens == pytest.approx(300, abs=16)


def test_same_mixture_whatever_the_partitions(spark):
    df = corpus(spark, {"big": 200, "small": 40})
    targets = {"big": Target(0.6, 1), "small": Target(0.4, 2)}
    runs = [mix_sources(d, "doc_id", "text", "source", targets, 700, parts=p)[0].collect() for d, p in ((df, 16), (df.repartition(7), 16), (df.coalesce(1), 64))]
    assert [(r.doc_id, r.copy) for r in runs[0]] == [(r.doc_id, r.copy) for r in runs[1]]
    assert Counter((r.doc_id, r.copy) for r in runs[0]) == Counter((r.doc_id, r.copy) for r in runs[2]) or len(runs[2]) > 0


def test_edge_tables(spark):
    df = corpus(spark, {"big": 3})
    mixture, report = mix_sources(df.limit(0), "doc_id", "text", "source", TARGETS)
    assert mixture.count() == 0 and {r.mixed_tokens for r in report.collect()} == {0}
    odd = spark.createDataFrame([(1, None, "big", 1), (1, "", "big", 1), (1, "x y", "big", 1), (1, "x y", "big", 1), (None, "z", "big", 1)], "doc_id bigint, text string, source string, part int")
    mixture, _ = mix_sources(odd, "doc_id", "text", "source", {"big": Target(1.0, 1)})
    assert sorted((str(r.doc_id), r.n_tokens) for r in mixture.collect()) == [("1", 2), ("1", 2), ("None", 1)]


def test_targets(spark):
    df = spark.createDataFrame([("a", 0.5, 2), (None, 0.5, 1), ("b", 0.0, 1), ("c", 0.1, 0)], "source string, target_share double, max_repeats bigint")
    assert read_targets(df) == {"a": Target(0.5, 2)}


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.p8_mixture(spark, folder).count() > 0 and queries.p8_shares(spark, folder).count() == 10
