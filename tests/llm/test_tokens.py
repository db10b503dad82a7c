"""Ids against whole-text encoding and round trips, with texts cut at any place."""

import random

import pytest
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.llm import queries
from tabspark.llm import tokens as K

VOCABULARY = K.Vocabulary()
SAMPLES = [
    "", "a", "Hello  world\n\n\n it's   fine, they'll see!  ", "\t \n x  \r\n y", "naïve café — 数字と漢字 русский текст 12345678", "<|endoftext|> is text", "🙂🙃" * 9,
    "don't'can't  1,000.50 '''    x",
]


def whole(text):
    return K.load_tokenizer(VOCABULARY.file).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 5), (16, 4), (40, 30), (100, 20)])
def test_pieces_give_the_ids_of_the_whole(chunk, overlap):
    rng = random.Random(chunk)
    alphabet = ["a", "b", " ", " ", "\n", "'s", "'", "1", ".", "!", "é", "漢", "🙂", "  ", "word", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += ["x" * 500, " " * 500, "a" * 200 + " b" * 100, "\n " * 200, "1" * 333 + "," * 333] + SAMPLES
    small = K.Vocabulary(chunk=chunk, overlap=overlap)
    flat, counts = K.encode_batch(texts, small)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert "".join(K.divide(K.load_tokenizer(small.file), text, chunk, overlap)) == text
        assert flat[at : at + n].tolist() == whole(text)
        at += n


def test_long_texts_are_divided():
    text = "The quick brown fox, it's said, jumps.\n" * 5000
    parts = K.divide(K.load_tokenizer(VOCABULARY.file), text, 50_000, 1_000)
    assert len(parts) == 4 and "".join(parts) == text
    assert K.encode_batch([text], VOCABULARY)[0].tolist() == whole(text)


def test_time_of_texts_without_boundaries():
    """Each stretch is looked at again at twice the length only."""
    looked, tokenizer = [], K.load_tokenizer(VOCABULARY.file)

    class Counting:
        class pre_tokenizer:  # noqa: N801
            @staticmethod
            def pre_tokenize_str(text):
                looked.append(len(text))
                return tokenizer.pre_tokenizer.pre_tokenize_str(text)

    assert len(K.divide(Counting, "x" * 100_000, 100, 20)) == 1 and sum(looked) < 300_000


def awkward(rng, n):
    alphabet = ["a", "b", " ", " ", "\n", "'s", "'", "1", ".", "!", "é", "漢", "🙂", "  ", "word", "\t"]
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (64, 40)])
def test_chunks_over_tasks_give_the_ids_of_the_whole(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = [awkward(rng, rng.randrange(600)) for _ in range(150)] + ["x" * 500, " " * 500, "a" * 200 + " b" * 100, "\n " * 200, "1" * 333 + "," * 333, *SAMPLES, None]
    small = K.Vocabulary(chunk=chunk, overlap=overlap)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(5)
    got = {r.k: r for r in K.encode_corpus(df, "text", small, count="n").collect()}
    assert {k: r.ids for k, r in got.items()} == {k: whole(t or "") for k, t in enumerate(texts)} and all(r.n == len(r.ids) for r in got.values())
    counted = {r.k: r.n for r in K.encode_corpus(df, "text", small, None, "n").collect()}
    assert counted == {k: r.n for k, r in got.items()}
    # Most long texts go through chunks of their own.
    longer = df.where(F.char_length("text") > chunk + overlap).select(F.col("k").cast("bigint").alias("row"), "text")
    assert K.cut_chunks(longer, small).groupBy("row").count().agg(F.max("count")).first()[0] > 5


def test_decoding_gives_the_text_back():
    for text in SAMPLES:
        assert K.decode(K.encode_batch([text], VOCABULARY)[0].tolist(), VOCABULARY) == text


def test_corpus(spark):
    rows = [(i, t, "z") for i, t in enumerate([*SAMPLES, None, "", "y " * 100_000])]
    df = spark.createDataFrame(rows, "k int, text string, ids string")
    got = {r.k: r for r in K.encode_corpus(df, "text", count="n").collect()}
    assert {k: r.ids for k, r in got.items()} == {k: whole(t or "") for k, t, _ in rows}
    assert all(r.n == len(r.ids) for r in got.values())


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 2)], "k int, text string, _text int")
    out = K.encode_corpus(df, "text")
    assert out.columns == ["k", "_text", "ids"] and out.count() == 2 and out.first()._text == 2
    assert K.encode_corpus(df.limit(0), "text").count() == 0
    with pytest.raises(SchemaError):
        K.encode_corpus(df, "nothing")


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, folder).collect()} == {k: whole(t or "") for k, t in docs.items()}


def test_joined_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.p7_joined(spark, folder).collect()
    docs = sorted((r.doc_id, r.text or "") for r in queries.table(spark, folder, "documents").collect())
    joined = "\n".join(t for _, t in docs)
    assert [len(r.ids) for r in got] == [len(whole(joined))] and got[0].ids == whole(joined) and len(joined) > 150_000
