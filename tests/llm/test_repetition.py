"""Repeated stretches against a plain count, and fertility against its definition."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tabspark.errors import SchemaError
from tabspark.llm import queries
from tabspark.llm import repetition as R


def plain(text, length):
    kept = "".join(c for c in (text or "").lower() if c.isalnum())
    seen, covered = set(), [False] * len(kept)
    for i in range(len(kept) - length + 1):
        if kept[i : i + length] in seen:
            covered[i : i + length] = [True] * length
        seen.add(kept[i : i + length])
    return len(kept), sum(covered)


@pytest.mark.parametrize("length", [1, 3, 8, 30])
def test_counts_against_plain(length):
    rng = random.Random(length)
    words = ["alpha", "Beta", "γάμμα", "数字", "Δ9", "x-y", "İstanbul", "  ", "!"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", "!!!", "a" * 100, "ab" * 50, "abc" * 9 + "ab", "The same sentence. " * 20]
    kept, repeated = R.repeated_counts(texts, length)
    assert list(zip(kept.tolist(), repeated.tolist(), strict=True)) == [plain(t, length) for t in texts]


def test_false_matches_are_done_again(monkeypatch):
    monkeypatch.setattr(R, "_hashes", lambda chars, length: np.zeros(len(chars) - length + 1, np.uint64))
    texts = ["hello world hello world", "nothing twice here", "abcabcabc"]
    kept, repeated = R.repeated_counts(texts, 3)
    assert list(zip(kept.tolist(), repeated.tolist(), strict=True)) == [plain(t, 3) for t in texts]


def test_rows(spark):
    rows = [(1, "same words over and over again and once more " * 3, 5), (2, None, 5), (3, "", 5), (1, "short", 5), (4, "long text " * 60_000, 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, kept_chars int")
    out = R.repeated_share(df, "text")
    assert out.columns == ["doc_id", "kept_chars", "repeated_chars"]
    got = sorted(map(tuple, out.collect()))
    assert got[:4] == sorted([(1, *plain(rows[0][1], 30)), (1, 5, 0), (2, 0, 0), (3, 0, 0)]) and got[4][2] > 0.99 * got[4][1]
    assert R.repeated_share(df.limit(0), "text").count() == 0
    with pytest.raises(SchemaError):
        R.repeated_share(df, "nothing")


def test_fertility(spark):
    texts = ["the cat the cat the cat", None, "", "x", "Съешь же ещё этих мягких", "漢字のテキストです", "🙂🙃 ꙮ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in R.fertility(df, "text").collect()}
    ids = R.encode_batch([texts[0]], R.Vocabulary())[0].tolist()
    p = [n / len(ids) for n in Counter(ids).values()]
    assert got[0].n_tokens == len(ids) and got[0].chars_per_token == len(texts[0]) / len(ids)
    assert got[0].token_entropy == pytest.approx(-sum(x * math.log2(x) for x in p) / math.log2(len(ids)))
    assert got[0].fallback_share == 0 and got[6].fallback_share > 0.3
    assert [got[i].script for i in range(7)] == ["latin", "other", "other", "latin", "cyrillic", "kana", "other"]
    assert got[1].n_tokens == 0 and got[1].chars_per_token is None and got[2].fallback_share is None and got[3].token_entropy is None


def test_bands(spark):
    rng = random.Random(8)
    usual = [" ".join(rng.sample("one two three four five six seven eight nine ten eleven twelve".split(), 11)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*usual, "spam " * 200, None])), "i int, text string")
    out = {r.i: r.outside for r in R.outside_bands(df, "text").collect()}
    assert "token_entropy" in out[200] and out[201] == [] and sum(bool(x) for x in out.values()) < 10
    assert R.outside_bands(df.limit(0), "text").count() == 0


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    want = {k for k, t in docs.items() if (c := plain(t, 30))[0] and c[1] * 5 >= c[0] * 2}
    assert {r.doc_id for r in queries.p9_found(spark, folder).collect()} == want
    assert queries.p9_share(spark, folder).count() == queries.p9_fertility(spark, folder).count() == len(docs)
