"""Fuzzy scoring against a direct reading of its definition."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinmatch.functions.fuzzy import WordLengthGroups, closeness, closeness_of
from kinmatch.operators import keyword_score, recommend
from kinmatch.plans.presets import PROJECT_COLUMNS, PROJECT_SCHEMA

WORDS = "erp cost costs model erpx system 시스템 시스템을 구축 구축하려고 (cost) a in ring café crm martha".split()


def test_known_closeness():
    assert closeness("same", "same") == 1.0
    assert closeness("", "a") == 0.0 and closeness("a", "b") == 0.0
    # 6 of 6 pair, one swap counts as two half transpositions, prefix of 3
    assert closeness("martha", "marhta") == pytest.approx(0.9611111, abs=1e-6)
    # low overlap still gets the prefix bonus
    assert closeness("abcdxyzw", "abcdmnop") > (0.5 + 0.5 + 1) / 3


def test_array_form_equals_scalar_form():
    random.seed(5)
    words = sorted({"".join(random.choice("abcd가é😀") for _ in range(random.randint(1, 11))) for _ in range(800)})
    groups = WordLengthGroups(words)
    for text in random.sample(words, 60) + ["zz", ""]:
        got = {words[i]: v for m, vs in groups.closer_than(text, 0.7) for i, v in zip(m, vs)}
        assert got == {w: closeness(text, w) for w in words if closeness(text, w) > 0.7}


def test_column_form(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("a", "")], "a string, b string")
    got = [r[0] for r in rows.select(closeness_of(F.col("a"), F.col("b"))).collect()]
    assert got == [closeness("martha", "marhta"), 0.0]


def expected_score(keywords, fields, prompt):
    text = " ".join(f.lower() for f in fields if f)
    words = text.split()
    parts, hits = [], 0
    for keyword in (k.lower() for k in keywords):
        if keyword in text:
            parts.append(0.4)
            hits += 1
        else:
            close = [v for v in (closeness(keyword, w) for w in words) if v > 0.7]
            parts.append(0.2 * close[0] if close else 0.0)
    score = 0.0
    for part in parts:
        score += part
    score += (hits / len(keywords) if keywords else 0.0) * 0.3
    asked = prompt.lower().split()
    common = sum(any(c in w or w in c for c in words) for w in asked)
    score += (common / len(asked) if asked else 0.0) * 0.3
    return min(score, 1.0)


def project(i, rng):
    def words(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return (
        f"P{i:03}", f"[{words(1)}] {words(2)}", None, None, words(1), None,
        words(1) if i % 3 else None, "", None, words(rng.randint(0, 6)), None, None,
        dt.datetime(2026, 1, 1 + i % 3), None,
    )


REQUESTS = [
    (1, "ERP 시스템을 구축하려고 costt", None, 25),
    (2, "cost model cost (zzz) a", ["cost model", "CRM", "sistem", "crm"], 5),
    (3, "qqqq", [], 4),
    (4, "anything", ["", "martah", " "], 10),
    (5, "   ", None, 5),
    (6, "erp", None, -1),
    (7, "erp", None, 0),
]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    projects = [project(i, rng) for i in range(40)]
    return projects, spark.createDataFrame(projects, PROJECT_SCHEMA).repartition(3)


def prepared(spark):
    requests = spark.createDataFrame(REQUESTS, "id int, prompt string, given array<string>, n int")
    return recommend.prepared_requests(
        requests, query_col="id", prompt_col="prompt", limit_col="n", keywords_col="given"
    )


@pytest.mark.parametrize("blocks", [False, True])
def test_ranking_equals_brute_force(spark, data, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(keyword_score, "BROADCAST_REQUESTS", 1)
        monkeypatch.setattr(keyword_score, "REQUEST_BLOCK", 2)
        monkeypatch.setattr(keyword_score, "RECORD_BLOCK", 9)
    monkeypatch.setattr(keyword_score, "RECORDS_PER_STEP", 4)
    projects, records = data
    asked = prepared(spark)
    got = keyword_score.nearest_by_keywords(
        asked, records, query_col="id", prompt_col="prompt", keywords_col="keywords",
        key_col="project_code", score_cols=PROJECT_COLUMNS.score, order_col="created_at",
    )
    ranking = {}
    for r in got.orderBy("id", "rank").collect():
        ranking.setdefault(r.id, []).append((r.project_code, r.score))
    names = [f.name for f in PROJECT_SCHEMA]
    for request in asked.collect():
        scored = []
        for p in projects:
            row = dict(zip(names, p))
            score = expected_score(
                request.keywords, [row[c] for c in PROJECT_COLUMNS.score], request.prompt
            )
            scored.append((-score, -row["created_at"].timestamp(), row["project_code"], score))
        want = [(code, score) for _, _, code, score in sorted(scored)[:10]]
        assert ranking[request.id] == want, request.id


def test_routing_limits_and_documents(spark, data):
    import json

    _, records = data
    records = records.withColumn("embedding", F.array(*[F.lit(float(i)) for i in (1, 2)]).cast("array<float>"))
    asked = prepared(spark).withColumn(
        "embedding", F.when(F.col("id") == 1, F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    )
    hits = recommend.recommend(asked, records, PROJECT_COLUMNS, query_col="id", prompt_col="prompt")
    counts = {(r.id, r.path): r["count"] for r in hits.groupBy("id", "path").count().collect()}
    assert counts == {(1, "vector"): 10, (2, "keyword"): 5, (3, "keyword"): 4, (4, "keyword"): 10}
    documents = {
        r.id: r
        for r in recommend.result_documents(
            asked, hits, PROJECT_COLUMNS, query_col="id", prompt_col="prompt"
        ).collect()
    }
    assert len(documents) == len(REQUESTS)
    assert documents[5].document == "blank message" and documents[6].document == "negative limit"
    empty = json.loads(documents[7].document)
    assert empty["totalResults"] == 0 and empty["recommendations"] == [] and empty["message"]
    full = json.loads(documents[2].document)
    assert full["totalResults"] == 5 and "message" not in full
    first = full["recommendations"][0]
    assert first["projectCode"].startswith("P") and first["score"] == round(first["score"], 2)


def test_a_fickle_model_neither_loses_nor_doubles_a_request(spark):
    """The model refuses at random whenever it is asked; each request takes one path."""
    import random

    from kinmatch.operators import embedding, recommend

    def factory():
        def embed(texts):
            if random.SystemRandom().random() < 0.5:
                raise RuntimeError("busy")
            return [[1.0, len(t)] for t in texts]

        return embed

    records = spark.createDataFrame(
        [(i, f"solar plant number {i}", [1.0, float(i)]) for i in range(8)], "id long, title string, embedding array<float>"
    )
    asked = spark.createDataFrame([(i, f"solar plant {i}") for i in range(60)], "q long, prompt string").repartition(12)
    requests = recommend.prepared_requests(asked, query_col="q", prompt_col="prompt")
    requests = embedding.embed(
        requests, key_col="q", text_col="prompt", model=factory, size=2, rows_per_call=1,
        keep=["prompt", "extracted", "keywords", "limit", "problem"],
    )
    columns = recommend.RecordColumns(key="id", title="title", match=["title"], score=["title"])
    hits = recommend.recommend(requests, records, columns, query_col="q", prompt_col="prompt")
    paths = hits.select("q", "path").distinct().groupBy("path").count()
    found = {r.path: r["count"] for r in paths.collect()}
    assert sum(found.values()) == 60 and set(found) == {"vector", "keyword"}
    assert hits.groupBy("q").count().filter("count != 5").count() == 0
