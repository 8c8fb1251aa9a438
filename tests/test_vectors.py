import math
import re

import numpy as np
import pandas as pd
import pytest
from conftest import plan
from pyspark.sql import functions as F

from kinmatch.operators import embedding, vector_search
from kinmatch.operators.vector_search import nearest, nearest_batch


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(-3, 4, size=(60, 6)).astype(float).tolist()
    points[5] = [0.0] * 6
    points[9] = points[8]
    rows = [(i, p) for i, p in enumerate(points)] + [(60, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def brute(vecs, k):
    rows = sorted((r.id, r.embedding) for r in vecs.collect() if r.embedding is not None)
    out = {}
    for q, a in rows:
        scored = []
        for r, b in rows:
            scale = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            cosine = sum(x * y for x, y in zip(a, b)) / scale if scale else float("-inf")
            scored.append((1 - min(cosine, 1.0), r))
        out[q] = [r for _, r in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append(r.id)
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_batch_equals_brute_force(spark, vecs, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(vector_search, "BROADCAST_QUERIES", 5)
        monkeypatch.setattr(vector_search, "QUERY_BLOCK", 11)
        monkeypatch.setattr(vector_search, "RECORD_BLOCK", 13)
    asked = vecs.withColumnRenamed("id", "q")
    got = ranked(nearest_batch(asked, vecs, query_col="q", key_col="id", k=7))
    assert got == brute(vecs, 7)


@pytest.mark.parametrize("k", [1, 4])
def test_pruned_join_on_clustered_vectors(spark, monkeypatch, k):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 12)) * 5
    points = np.concatenate([c + rng.normal(size=(40, 12)) * 0.3 for c in centres])
    # a third of all records are copies of one
    points[:120] = points[0]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = vecs.filter("id >= 100").withColumnRenamed("id", "q")
    want = ranked(nearest_batch(asked, vecs, query_col="q", key_col="id", k=k))
    monkeypatch.setattr(vector_search, "BROADCAST_QUERIES", 5)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 50)
    monkeypatch.setattr(vector_search, "RECORD_BLOCK", 20)
    got = ranked(nearest_batch(asked, vecs, query_col="q", key_col="id", k=k))
    assert got == want
    met = []
    from kinmatch.operators import pivots as pv

    original = pv._met_cells
    monkeypatch.setattr(pv, "_met_cells", lambda *a: met.append(original(*a)) or met[-1])
    nearest_batch(asked, vecs, query_col="q", key_col="id", k=k)
    # far fewer than queries x cells
    cells = met[0].select("cell").distinct().count()
    assert met[0].count() < 0.5 * asked.count() * cells


def test_single_equals_batch(spark, vecs):
    query = vecs.filter("id = 8").first().embedding
    one = [r.id for r in nearest(vecs, query, key_col="id", k=7).collect()]
    assert one == brute(vecs, 7)[8]
    assert one[:2] == [8, 9]


def test_zero_vector_sorts_last_and_passes_threshold(spark, vecs):
    query = vecs.filter("id = 8").first().embedding
    rows = nearest(vecs, query, key_col="id", k=None).collect()
    assert rows[-1].id == 5 and np.isnan(rows[-1].score)
    kept = nearest(vecs, query, key_col="id", k=None, threshold=2.0).collect()
    assert [r.id for r in kept] == [5]


def test_single_query_plan_is_a_top_k_without_python(spark, vecs):
    text = plan(nearest(vecs, [1.0] * 6, key_col="id", k=3))
    assert "TakeOrderedAndProject" in text
    assert "Python" not in text and "MapInArrow" not in text


def test_batch_plan_limits_before_the_shuffle(spark, vecs):
    text = plan(nearest_batch(vecs.withColumnRenamed("id", "q"), vecs, query_col="q", key_col="id"))
    assert "WindowGroupLimit" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_sizes_must_agree(spark, vecs):
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "q long, embedding array<float>")
    with pytest.raises(Exception, match="vector sizes differ"):
        nearest_batch(asked, vecs, query_col="q", key_col="id").collect()


def model():
    """A model whose code travels with the job, as a notebook's would."""

    def factory():
        def embed(texts):
            if "bad" in texts:
                raise RuntimeError("refused")
            return [[len(t), 1] if t != "long" else [1, 2, 3, 4, 5] for t in texts]

        return embed

    return factory


def test_embed_isolates_failures_and_repairs_size(spark):
    rows = spark.createDataFrame(
        [(1, " ab "), (2, "bad"), (3, "  "), (4, "long"), (5, None)], "id int, t string"
    )
    got = {r.id: r for r in embedding.embed(rows, key_col="id", text_col="t", model=model(), size=3).collect()}
    assert got[1].embedding == [2, 1, 0] and got[1].error is None
    assert got[2].embedding is None and got[2].error == "refused"
    assert got[3].embedding is None and "blank" in got[3].error
    assert got[4].embedding == [1, 2, 3] and got[5].embedding is None


def test_store_backfill_reuses_and_adds(spark):
    rows = spark.createDataFrame(
        [(1, "ab", None), (2, " ab", None), (3, "known", None), (4, "x", [9.0, 9.0, 9.0]), (5, "bad", None), (6, " ", None)],
        "id int, t string, embedding array<float>",
    )
    store = rows.filter("id = 3").select(
        embedding.content_key(F.col("t")).alias("text_sha"),
        F.array(*[F.lit(7.0).cast("float")] * 3).alias("embedding"),
    )
    after = embedding.backfill(rows, key_col="id", text_cols=["t"], model=model(), size=3, store=store)
    got = {r.id: (r.embedding, r.error) for r in after.collect()}
    assert got[1][0] == got[2][0] == [2, 1, 0]
    assert got[3][0] == [7, 7, 7] and got[4][0] == [9, 9, 9]
    assert got[5] == (None, "refused") and "blank" in got[6][1]
    numbers = embedding.store_stats(rows, store, text_col="t").first()
    assert (numbers.lookups, numbers.hits, numbers.misses, numbers.hit_rate) == (5, 2, 3, "40.0%")


def test_named_values(spark):
    from kinmatch.functions.vectors import from_named_values

    row = spark.createDataFrame([({"a": 1.0, "b": 2.0},)], "m map<string,double>")
    assert row.select(from_named_values(F.col("m"), 3)).first()[0] == [1, 2, 0]


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("k", [1, 3, 5])
def test_vectors_without_direction_rank_last_in_every_path(spark, monkeypatch, blocks, k):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.1])]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(2)
    want = {q: [r.id for r in nearest(vecs, v, key_col="id", k=k).collect()] for q, v in rows}
    assert want[5] == [5, 2, 1, 3, 4][:k] and want[1] == [1, 2, 3, 4, 5][:k]
    if blocks:
        monkeypatch.setattr(vector_search, "BROADCAST_QUERIES", 1)
    asked = vecs.withColumnRenamed("id", "q")
    assert ranked(nearest_batch(asked, vecs, query_col="q", key_col="id", k=k)) == want


@pytest.mark.parametrize("blocks", [False, True])
def test_huge_and_tiny_vectors_have_the_distance_of_their_direction(spark, monkeypatch, blocks):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 0.9]), (3, [-1.0, 0.0]), (4, [3e-200, 3e-200]), (5, [1e308, -1e308]), (6, [5e-324, 0.0])]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 1.0]), (7, [2e200, 1e200])], "q long, embedding array<double>")
    if blocks:
        monkeypatch.setattr(vector_search, "BROADCAST_QUERIES", 1)
    found = nearest_batch(asked, vecs, query_col="q", key_col="id", k=6)
    assert ranked(found) == {0: [1, 4, 2, 6, 5, 3], 7: [2, 1, 4, 6, 5, 3]}
    one = [(r.id, r.distance) for r in nearest(vecs, [1.0, 1.0], key_col="id", k=6).collect()]
    assert one == [(r.id, r.distance) for r in found.filter("q = 0").orderBy("rank").collect()]
    assert one[0][1] == pytest.approx(0, abs=1e-15) and one[2][1] == pytest.approx(1 - 1.9 / math.sqrt(2 * 1.81))


def test_batch_search_starts_no_job_over_the_records(spark, vecs):
    started = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    asked = spark.createDataFrame([(1, [1.0] * 6)], "q long, embedding array<float>")
    nearest_batch(asked, vecs, query_col="q", key_col="id", k=3)
    # the queries are fetched, and no more
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - started <= 2


def test_a_bad_text_costs_few_calls():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [[len(t)] for t in texts]

    for at in (0, 511, 1023):
        calls.clear()
        texts = [f"t{i}" for i in range(1024)]
        texts[at] = "bad"
        got, errors = embedding._embed_texts(model, texts, 1)
        assert [i for i, e in enumerate(errors) if e] == [at] and got[at] is None
        assert len(calls) <= 21 and [len(t) for i, t in enumerate(texts) if i != at] == [int(v[0]) for v in got if v is not None]


def test_only_keys_and_hashes_meet_the_store(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store = docs.filter("doc_id % 5 = 0").select(embedding.content_key(F.col("text")).alias("text_sha")).distinct()
    settled = []
    original = embedding.settled
    try:
        embedding.settled = lambda df, name: settled.append(plan(df)) or original(df, name)
        missing = embedding.texts_not_stored(docs, store, text_col="text", key_col="doc_id")
    finally:
        embedding.settled = original
    exchanges = [line for line in settled[0].splitlines() if "Exchange" in line]
    assert exchanges and "text#" not in settled[0].split("Exchange")[0].split("HashAggregate")[0]
    old = embedding.texts_not_stored(docs, store, text_col="text")
    assert sorted(map(tuple, missing.collect())) == sorted(map(tuple, old.collect()))


def test_a_block_of_the_join_holds_few_scores_at_once():
    """What a task holds doesn't grow with the block: 2048 queries and 16384 records took 270 MB."""
    import tracemalloc

    dice = np.random.default_rng(1)
    asked = pd.DataFrame({"query": range(2048), "query_vector": list(dice.normal(size=(2048, 4)))})
    held = pd.DataFrame({"key": range(16384), "vector": list(dice.normal(size=(16384, 4)))})
    kernel = vector_search._block_kernel(3)
    tracemalloc.start()
    found = kernel(asked, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3 * 2048 and peak < 80e6


def test_tiles_cover_a_batch_and_bound_its_scores():
    for records, queries in ((0, 5), (10, 0), (10_000, 1), (10_000, 4096)):
        starts, size = vector_search.tile_starts(records, queries)
        assert [*range(records)] == [i for a in starts for i in range(a, min(a + size, records))]
        assert size * queries <= max(vector_search.TILE_VALUES, 64 * queries)


def test_backfill_moves_no_texts_to_meet_the_store(spark):
    rows = [(1, "river mill", None), (2, " ", None), (3, "river mill", None), (4, "kept", [1.0, 0.0]), (5, "stored text", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, embedding array<float>")
    model = embedding.hashed_terms(2)
    store = spark.createDataFrame([("stored text",)], "text string").select(
        embedding.content_key(F.col("text")).alias("text_sha"), F.array(F.lit(7.0), F.lit(8.0)).cast("array<float>").alias("embedding")
    )
    after = embedding.backfill(table, key_col="doc_id", text_cols=["text"], model=model, size=2, store=store)
    found = {r.doc_id: r for r in after.collect()}
    assert found[5].embedding == [7.0, 8.0] and found[4].embedding == [1.0, 0.0]
    assert found[1].embedding == found[3].embedding and sum(found[1].embedding) == 2
    assert found[2].embedding is None and found[2].error == "blank text cannot be embedded"
    assert [r.error for r in found.values() if r.doc_id != 2] == [None] * 4
    # what is moved by its hash has no column for the text that was put together
    lines = plan(after.select("doc_id", "embedding", "error")).splitlines()
    moved = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(text_sha" in line]
    assert moved and not any(re.search(r"(, |\[)_text#\d+(,|\])", line) for line in moved)


def test_tokens_remembered_by_a_task_are_bounded():
    """The places of 200 000 tokens took about 30 MB and were kept; values don't depend on it."""
    import tracemalloc

    run = embedding.hashed_terms(16)()
    tracemalloc.start()
    for start in range(0, 200_000, 1000):
        run([f"token{k}" for k in range(start, start + 1000)])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 16e6
    assert (run(["token5 token7"]) == embedding.hashed_terms(16)()(["token5 token7"])).all()
