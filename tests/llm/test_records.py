"""The mixture with its records."""

from tabspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_each_use_has_its_record(spark):
    uses = queries.QUERIES["p8_mixture"](spark, FOLDER).collect()
    records = queries.QUERIES["p8_records"](spark, FOLDER).collect()
    documents = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert [tuple(r[c] for c in uses[0].asDict()) for r in records] == [tuple(u) for u in uses] and any(u.copy > 0 for u in uses)
    assert all(r[c] == v for r in records for c, v in documents[r.doc_id].items())
