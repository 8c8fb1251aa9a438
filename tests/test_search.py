import pytest
from conftest import plan
from pyspark.sql import functions as F

from kinmatch.operators import search

RECORDS = [
    (1, "ERP 구축 Model", None, 5), (2, "erp", "100%_done", 7), (3, "", "The mode", 7),
    (4, "x", "y", 1), (5, None, "구", 9), (6, "a\nb", "c", 2),
]
KEYWORDS = ["ERP", "mode", "구축 m", "", "%", "_", "zz", "b", "el", "A\nB", "구"]


def brute(keyword):
    return sorted(
        i for i, a, b, _ in RECORDS if any(keyword.lower() in (c or "").lower() for c in (a, b))
    )


@pytest.mark.parametrize("path", ["literal", "words", "probe"])
def test_all_paths_agree(spark, monkeypatch, path):
    if path != "literal":
        monkeypatch.setattr(search, "LITERAL_KEYWORDS", 0)
    if path == "probe":
        monkeypatch.setattr(search, "BROADCAST_KEYWORDS", 0)
    records = spark.createDataFrame(RECORDS, "id int, a string, b string, t int")
    keywords = spark.createDataFrame([(k,) for k in KEYWORDS], "k string")
    found = search.search_keywords(
        keywords, records, keyword_col="k", search_cols=["a", "b"], key_col="id", order_col="t"
    )
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(k) for k in KEYWORDS if brute(k)}
    top = search.search_keywords(
        keywords, records, keyword_col="k", search_cols=["a", "b"], key_col="id", order_col="t",
        limit=2,
    )
    best = [(r.id, r["rank"]) for r in top.filter("k = ''").orderBy("rank").collect()]
    assert best == [(5, 1), (2, 2)]


@pytest.mark.parametrize("path", ["literal", "words", "probe"])
def test_wildcards(spark, monkeypatch, path):
    if path != "literal":
        monkeypatch.setattr(search, "LITERAL_KEYWORDS", 0)
    if path == "probe":
        monkeypatch.setattr(search, "BROADCAST_KEYWORDS", 0)
    records = spark.createDataFrame(RECORDS, "id int, a string, b string, t int")
    keywords = spark.createDataFrame([("e_p%mod",), ("%",), ("\\%",)], "k string")
    found = search.search_keywords(
        keywords, records, keyword_col="k", search_cols=["a", "b"], key_col="id", wildcards=True
    )
    got = {}
    for r in found.collect():
        got.setdefault(r.k, set()).add(r.id)
    assert got == {"e_p%mod": {1}, "%": {1, 2, 3, 4, 5, 6}, "\\%": {2}}


def test_many_keywords_by_brute_force(spark, sf):
    """Every word and some parts of words of the benchmark, in whole documents, without Python."""
    records = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    keywords = items.select(F.explode(F.split("text", " ")).alias("k")).distinct()
    keywords = keywords.unionByName(keywords.select(F.substring("k", 2, 4).alias("k"))).distinct()
    found = search.search_keywords(
        keywords, records, keyword_col="k", search_cols=["text", "source"], key_col="doc_id"
    ).select("k", "doc_id")
    text = plan(found)
    assert "Python" not in text and "MapInArrow" not in text
    rows = [(r.doc_id, [(c or "").lower() for c in (r.text, r.source)]) for r in records.collect()]
    want = {(k.k, i) for k in keywords.collect() for i, cells in rows if any(k.k.lower() in c for c in cells)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lookup_and_filter(spark):
    records = spark.createDataFrame(RECORDS, "id int, a string, b string, t int")
    keys = spark.createDataFrame([(2,), (99,), (2,)], "id int")
    rows = search.lookup(keys, records, key_col="id").collect()
    assert sorted((r.id, r.found) for r in rows) == [(2, True), (2, True), (99, False)]
    newest = search.filter_equal(records, "t", 7, order_col="t", key_col="id")
    assert [r.id for r in newest.collect()] == [2, 3]


def test_details_of_found_and_missing_records(spark):
    prefix = "프로젝트 배경 및 요약: "
    records = spark.createDataFrame([("k1", f"{prefix}One 'é'", 3), ("k2", None, None)], "id string, s string, n int")
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",), (None,)], "id string")
    found = search.detail_documents(keys, records, key_col="id", shown={"id": "code", "s": "summary", "n": "n"}, summary_col="s")
    assert {r.id: (r.found, r.document) for r in found.collect()} == {
        "k1": (True, '{"code":"k1","summary":"One \'é\'","n":3}'), "k2": (True, '{"code":"k2","summary":"","n":null}'),
        "k3": (False, "ID 'k3'에 해당하는 프로젝트를 찾을 수 없습니다."),
        None: (False, "ID 'None'에 해당하는 프로젝트를 찾을 수 없습니다."),
    }


def test_filters_and_columns_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    found = search.filter_equal(
        orders, "o_orderstatus", "F", order_col="o_orderdate", key_col="o_orderkey"
    ).select("o_orderkey")
    text = plan(found)
    assert "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text


def test_grams_cover_every_size(spark):
    row = spark.createDataFrame([("가a가a",), ("",)], "t string")
    got = [set(r[0]) for r in row.select(search.char_grams(F.col("t"), (0, 1, 2, 3))).collect()]
    assert got[0] == {"", "가", "a", "가a", "a가", "가a가", "a가a"} and got[1] == {""}


def test_newest_records_are_searched_first(spark, monkeypatch):
    """Bands give the hits of a whole search, and keywords with enough hits leave it early."""
    rows = [(i, "common word%d" % (i % 40) if i != 7 else "common rare", None if i % 50 == 0 else i // 3) for i in range(400)]
    rows += [(None, "common rare", 5), (3, "common word3", 1), (3, "common word3", 1)]
    records = spark.createDataFrame(rows, "id long, body string, size long")
    words = ["word%d" % i for i in range(40)] + ["common", "rare", "common rare", "nowhere", "or"]
    keywords = spark.createDataFrame([(w,) for w in words], "k string")

    def found():
        hits = search.search_keywords(
            keywords, records, keyword_col="k", search_cols=["body"], key_col="id", order_col="size", limit=5
        )
        return sorted(map(str, hits.collect()))

    whole = found()
    asked, one_by_one = [], search._test_each
    monkeypatch.setattr(search, "BAND_ROWS", 32)
    monkeypatch.setattr(search, "BAND_GROWTH", 4)
    monkeypatch.setattr(search, "_test_each", lambda r, words, *rest: asked.append(words) or one_by_one(r, words, *rest))
    assert found() == whole
    assert asked and "rare" in asked[-1] and not any("common" in words or "or" in words for words in asked)
    monkeypatch.setattr(search, "LITERAL_LEFT", 0)
    assert found() == whole
