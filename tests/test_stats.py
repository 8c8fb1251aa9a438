"""The statistics document."""

import json

from conftest import plan

from kinmatch.operators.stats import record_stats, stats_document


def test_null_and_the_text_null_are_one_key(spark):
    rows = [("total", None, 3), ("category", None, 1), ("category", "null", 2), ("domain", "x", 3)]
    found = stats_document(spark.createDataFrame(rows, "metric string, value string, n long"))
    document = json.loads(found.first()["document"])
    assert document["industryDistribution"] == {"null": 3}
    assert document["totalProjects"] == 3


def test_one_scan_counts_everything(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = record_stats(
        documents, category_col="source", domain_col="lang", domain=["en", "none"], vector_col="n_chars"
    )
    text = plan(found)
    assert text.count("FileScan parquet") == 1 and "Join" not in text
    rows = documents.select("source", "lang").collect()
    want = {("total", None): len(rows), ("with_embedding", None): len(rows), ("without_embedding", None): 0}
    want |= {("category", s): sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    want |= {("domain", v): sum(r.lang == v for r in rows) for v in ("en", "none")}
    assert {(r.metric, r.value): r.n for r in found.collect()} == want


def test_statistics_of_nulls_and_of_nothing(spark):
    schema = "c string, d string, embedding array<float>"
    columns = {"category_col": "c", "domain_col": "d", "domain": ["A", "B"]}
    rows = spark.createDataFrame([(None, None, None), ("x", "A", [1.0]), (None, "Z", None)], schema)
    got = {(r.metric, r.value): r.n for r in record_stats(rows, **columns).collect()}
    zeros = {("total", None): 0, ("with_embedding", None): 0, ("without_embedding", None): 0, ("domain", "A"): 0, ("domain", "B"): 0}
    assert got == zeros | {("total", None): 3, ("with_embedding", None): 1, ("without_embedding", None): 2, ("domain", "A"): 1, ("category", None): 2, ("category", "x"): 1}
    assert {(r.metric, r.value): r.n for r in record_stats(rows.limit(0), **columns).collect()} == zeros
