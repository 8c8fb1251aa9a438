"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.functions import vectors
from kinmatch.operators import chat, embedding, recommend, search, stats, upsert, vector_search
from kinmatch.plans.presets import DOCUMENT_COLUMNS, PART_COLUMNS, PART_UPSERT
from kinmatch.sources import batches, tables
from kinmatch.sources.tables import read_spread, read_table, settled

# Vector size of the hashed-term model in these queries.
SIZE = 256
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def joined(words) -> Column:
    return F.array_join(words, " ")


# --- vectors ---------------------------------------------------------------------------


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vecs = read_table(spark, sf, "embeddings")
    request = vecs.filter("vec_id = 0").select("embedding").first()[0]
    return vector_search.nearest(vecs, request, key_col="vec_id", k=10)


@query
def vector_topk_threshold(spark, sf):
    vecs = read_table(spark, sf, "embeddings")
    request = vecs.filter("vec_id = 0").select("embedding").first()[0]
    return vector_search.nearest(vecs, request, key_col="vec_id", k=None, threshold=0.55)


@query
def vector_knn_batch(spark, sf):
    vecs = read_table(spark, sf, "embeddings")
    asked = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.nearest_batch(
        asked, vecs, query_col="query_id", key_col="vec_id", k=5
    )


@query
def vector_knn_signed(spark, sf):
    """Nearest neighbours among vectors turned round, zero, not numbers, huge or tiny."""
    factor = (
        F.when(F.col("vec_id") % 11 == 5, F.lit(float("nan")))
        .when(F.col("vec_id") % 5 == 0, 0.0).when(F.col("vec_id") % 5 == 1, -1.0)
        .when(F.col("vec_id") % 13 == 3, 2.0**700).when(F.col("vec_id") % 13 == 4, 2.0**-700)
        .otherwise(1.0)
    )
    vecs = read_table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * factor).alias("embedding")
    )
    asked = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_search.nearest_batch(asked, vecs, query_col="query_id", key_col="vec_id", k=5)
    return found.select(
        "query_id", "rank", "vec_id",
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("distance", "score")],
    )


@query
def vector_knn_threshold(spark, sf):
    vecs = read_table(spark, sf, "embeddings")
    asked = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.nearest_batch(
        asked, vecs, query_col="query_id", key_col="vec_id", k=10, threshold=0.65
    )


@query
def vector_dim_repair(spark, sf):
    def total(v):
        return F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 9)

    vecs = read_table(spark, sf, "embeddings").select(
        "vec_id",
        vectors.resized(F.col("embedding"), 80).alias("padded"),
        vectors.resized(F.col("embedding"), 32).alias("cut"),
    )
    return vecs.select(
        "vec_id",
        F.size("padded").cast("long").alias("padded_size"), total(F.col("padded")).alias("padded_sum"),
        F.size("cut").cast("long").alias("cut_size"), total(F.col("cut")).alias("cut_sum"),
    )


# --- text ------------------------------------------------------------------------------


@query
def tokenize(spark, sf):
    docs = read_spread(spark, sf, "documents").select(
        "doc_id",
        tx.tokens(F.col("text")).alias("all_tokens"),
    )
    return docs.select(
        "doc_id",
        F.size("all_tokens").cast("long").alias("n_tokens"),
        F.md5(joined("all_tokens")).alias("tokens_md5"),
    )


@query
def content_tokens(spark, sf):
    docs = read_spread(spark, sf, "documents").select(
        "doc_id", tx.content_tokens(F.col("text")).alias("kept")
    )
    return docs.select(
        "doc_id",
        F.size("kept").cast("long").alias("n_tokens"),
        F.md5(joined("kept")).alias("tokens_md5"),
    )


@query
def extract_keywords(spark, sf):
    docs = read_spread(spark, sf, "documents")
    # the outer form keeps the optimizer from computing the array a second time to test it
    ranked = docs.select(
        "doc_id", F.posexplode_outer(tx.ranked_keywords(F.col("text"), 10)).alias("pos", "k")
    ).filter(F.col("pos").isNotNull())
    return ranked.select("doc_id", (F.col("pos") + 1).alias("rank"), "k.token", "k.score")


@query
def noun_keywords(spark, sf):
    turns = read_spread(spark, sf, "conversations")
    return turns.select("conv_id", "turn", joined(tx.noun_keywords(F.col("text"))).alias("nouns"))


@query
def embedding_text(spark, sf):
    part = read_table(spark, sf, "part")
    brand = F.when(F.col("p_size") <= 10, F.lit(" \t ")).otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") > 40, F.lit(None)).otherwise(
        F.concat(F.lit("\n "), "p_type", F.lit(" "))
    )
    return part.select("p_partkey", tx.embedding_text(F.col("p_name"), brand, kind).alias("content"))


@query
def text_presentation(spark, sf):
    docs = read_spread(spark, sf, "documents")
    prefix = F.lit(tx.fixed.SUMMARY_PREFIX)
    marked = F.concat(prefix, "text", prefix)
    score = F.col("n_chars") / F.lit(7777.0)
    return docs.select(
        F.col("doc_id").alias("docId"),
        tx.ellipsis(F.col("text"), 200).alias("shortText"),
        F.md5(tx.without_prefix(marked)).alias("withoutPrefix"),
        F.md5(tx.without_prefix(marked, leading_only=True)).alias("withoutLeadingPrefix"),
        tx.two_decimals(score).alias("score"),
        tx.two_decimal_text(tx.two_decimals(score)).alias("scoreText"),
    )


@query
def matched_keywords(spark, sf):
    """Keywords of each user turn found in the turn that follows it."""
    turns = read_table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", tx.keywords(F.col("text"), 10).alias("keywords")
    )
    replies = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    words = tx.searchable_text(None, [F.col("reply")])
    pairs = asked.join(replies, ["conv_id", "turn"]).withColumn(
        "matched", tx.matched_keywords(F.col("keywords"), words)
    )
    return pairs.select(
        "conv_id", "turn", joined("keywords").alias("keywords"), joined("matched").alias("matched")
    )


# --- search and statistics -------------------------------------------------------------


@query
def ordered_scan(spark, sf):
    orders = read_table(spark, sf, "orders")
    return tables.newest_rows(orders, order_col="o_orderdate", key_col="o_orderkey")


@query
def filter_category(spark, sf):
    return search.filter_equal(
        read_table(spark, sf, "orders"), "o_orderpriority", "1-URGENT",
        order_col="o_orderdate", key_col="o_orderkey",
    )


@query
def filter_grade(spark, sf):
    return search.filter_equal(
        read_table(spark, sf, "orders"), "o_orderstatus", "F",
        order_col="o_orderdate", key_col="o_orderkey",
    ).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query
def lookup_keys(spark, sf):
    keys = read_table(spark, sf, "documents").select("doc_id")
    return search.lookup(keys, read_table(spark, sf, "labels"), key_col="doc_id")


@query
def detail_documents(spark, sf):
    """Details of twice every document's id, so that half of them aren't there."""
    docs = read_table(spark, sf, "documents")
    records = docs.select("doc_id", "lang", "n_chars", F.concat(F.lit(fixed.SUMMARY_PREFIX), "source").alias("overview"))
    shown = {"doc_id": "docId", "lang": "lang", "n_chars": "nChars", "overview": "overview"}
    return search.detail_documents(
        docs.select((F.col("doc_id") * 2).alias("doc_id")), records, key_col="doc_id", shown=shown, summary_col="overview"
    )


@query
def keyword_search_one(spark, sf):
    found = search.search_keyword(
        read_table(spark, sf, "part"), "RING", search_cols=["p_name", "p_brand", "p_type"],
        order_col="p_retailprice", key_col="p_partkey",
    )
    return found.select("p_partkey", "p_name")


@query
def keyword_search_wildcard(spark, sf):
    found = search.search_keyword(
        read_table(spark, sf, "part"), "r_d%O", search_cols=["p_name", "p_type"],
        order_col="p_retailprice", key_col="p_partkey", wildcards=True,
    )
    return found.select("p_partkey", "p_name")


@query
def keyword_search(spark, sf):
    """The ten newest parts for every word that occurs in a part name."""
    part = read_table(spark, sf, "part")
    words = part.select(F.explode(tx.split_words(F.col("p_name"))).alias("keyword")).distinct()
    found = search.search_keywords(
        words, part, keyword_col="keyword", search_cols=["p_name", "p_brand", "p_type"],
        key_col="p_partkey", order_col="p_retailprice", limit=10,
    )
    return found.select("keyword", "rank", "p_partkey", tx.ellipsis(F.col("p_name"), 6).alias("name"))


@query
def keyword_search_documents(spark, sf):
    """The ten longest documents for each of the ten keywords of every benchmark item."""
    items = read_table(spark, sf, "benchmark")
    words = items.select(F.explode(tx.keywords(F.col("text"), 10)).alias("keyword"))
    found = search.search_keywords(
        words, read_spread(spark, sf, "documents"), keyword_col="keyword",
        search_cols=["text", "source"], key_col="doc_id", order_col="n_chars", limit=10,
    )
    return found.select(
        "keyword", "rank", "doc_id", F.md5(tx.ellipsis(F.col("text"), 200)).alias("overview")
    )


def _documents_with_vectors(spark, sf, read=read_table) -> DataFrame:
    vecs = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return read(spark, sf, "documents").join(vecs, "doc_id", "left")


@query
def embedding_status(spark, sf):
    return embedding.embedding_status(_documents_with_vectors(spark, sf))


@query
def missing_embeddings(spark, sf):
    return embedding.without_embedding(
        _documents_with_vectors(spark, sf), order_col="n_chars", key_col="doc_id"
    ).select("doc_id", "lang", "n_chars")


@query
def category_distribution(spark, sf):
    return stats.category_counts(read_table(spark, sf, "documents"), "lang")


@query
def domain_distribution(spark, sf):
    return stats.domain_counts(
        read_table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "X"]
    )


def _document_stats(spark, sf):
    return stats.record_stats(
        _documents_with_vectors(spark, sf), category_col="source", domain_col="lang",
        domain=["en", "fr", "xx"],
    )


@query
def record_stats(spark, sf):
    return _document_stats(spark, sf)


@query
def stats_document(spark, sf):
    return stats.stats_document(_document_stats(spark, sf))


# --- embedding -------------------------------------------------------------------------


@query
def embed_texts(spark, sf):
    docs = read_spread(spark, sf, "documents")
    vecs = embedding.embed(
        docs, key_col="doc_id", text_col="text", model=embedding.hashed_terms(SIZE), size=SIZE
    )
    v = F.col("embedding")
    weighted = F.transform(v, lambda x, i: x.cast("double") * (i + 1))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x).cast("long")

    return vecs.select(
        "doc_id",
        F.size(v).cast("long").alias("size"),
        total(F.transform(v, lambda x: x.cast("double"))).alias("n_tokens"),
        total(weighted).alias("checksum"),
        vectors.squared_norm(v).cast("long").alias("squared_norm"),
        F.col("error").isNull().alias("ok"),
    )


def _labelled_store(spark, sf) -> DataFrame:
    """Vectors of the labelled documents' texts."""
    labelled = read_spread(spark, sf, "documents").join(
        read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    empty = spark.createDataFrame([], "text_sha string, embedding array<float>")
    return embedding.new_store_rows(
        labelled, empty, text_col="text", model=embedding.hashed_terms(SIZE), size=SIZE
    ).select("text_sha", "embedding")


@query
def embed_store_stats(spark, sf):
    docs = read_spread(spark, sf, "documents")
    return embedding.store_stats(docs, _labelled_store(spark, sf), text_col="text")


@query
def embed_store_extend(spark, sf):
    docs = read_spread(spark, sf, "documents")
    fresh = embedding.new_store_rows(
        docs, _labelled_store(spark, sf), text_col="text", key_col="doc_id",
        model=embedding.hashed_terms(SIZE), size=SIZE,
    )
    return fresh.select(
        "text_sha", vectors.squared_norm(F.col("embedding")).cast("long").alias("squared_norm")
    )


@query
def embed_store_lookup(spark, sf):
    docs = read_spread(spark, sf, "documents")
    found = embedding.with_stored_vectors(
        docs.select("doc_id", "text"), _labelled_store(spark, sf), text_col="text"
    )
    return found.select(
        "doc_id", F.col("embedding").isNotNull().alias("stored"),
        vectors.squared_norm(F.col("embedding")).cast("long").alias("squared_norm"),
    )


def _half_filled(spark, sf) -> DataFrame:
    """Documents of which those with a vector in ``embeddings`` have it as its rounded multiples."""
    docs = _documents_with_vectors(spark, sf, read_spread)
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("float"))
    return docs.withColumn("embedding", whole)


def _checksum(vector: Column) -> Column:
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x).cast("long")


@query
def embed_backfill(spark, sf):
    """Vectors of all documents, each missing text embedded once or taken from the store."""
    model = embedding.hashed_terms(64)
    labels = read_table(spark, sf, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    # all joins by document at once, stored: what follows moves no texts for them
    docs = settled(_half_filled(spark, sf).join(labels, "doc_id", "left"), "half-filled")
    labelled = docs.filter("labelled").drop("labelled")
    docs = docs.drop("labelled")
    empty = spark.createDataFrame([], "text_sha string, embedding array<float>")
    content = tx.embedding_text(F.col("text"), F.col("source"))
    store = embedding.new_store_rows(
        labelled.withColumn("content", content), empty, text_col="content", key_col="doc_id",
        model=model, size=64,
    ).select("text_sha", "embedding")
    store = settled(store, "store")
    after = embedding.backfill(
        docs, key_col="doc_id", text_cols=["text", "source"], model=model, size=64, store=store
    )
    return after.select(
        "doc_id", F.size("embedding").cast("long").alias("size"),
        _checksum(F.col("embedding")).alias("checksum"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def attach_vectors(spark, sf):
    """New vectors for the labelled documents; the others keep theirs."""
    fresh = embedding.embed(
        read_spread(spark, sf, "documents").join(
            read_table(spark, sf, "labels"), "doc_id", "left_semi"
        ),
        key_col="doc_id", text_col="text", model=embedding.hashed_terms(64), size=64,
    )
    base = _half_filled(spark, sf).withColumn("updated_at", F.lit(0).cast("long"))
    after = embedding.attach_vectors(
        base, fresh, key_col="doc_id", updated_col="updated_at", run_time=F.lit(1).cast("long")
    )
    return after.select(
        "doc_id", F.col("embedding").isNotNull().alias("filled"),
        _checksum(F.col("embedding")).alias("checksum"), "updated_at",
    )


# --- recommendation --------------------------------------------------------------------


def _requests(spark, sf) -> DataFrame:
    return recommend.prepared_requests(
        read_table(spark, sf, "benchmark"), query_col="item_id", prompt_col="text"
    )


def _vectors(df: DataFrame, key: str, text: str, model=None) -> DataFrame:
    """(key, embedding) of the texts."""
    return embedding.embed(
        df, key_col=key, text_col=text, model=model or embedding.hashed_terms(SIZE), size=SIZE
    ).select(key, "embedding")


def _requests_with_vectors(spark, sf, model=None) -> DataFrame:
    requests = _requests(spark, sf)
    return requests.join(_vectors(requests, "item_id", "text", model), "item_id", "left")


def _nearest_documents(spark, sf) -> tuple[DataFrame, DataFrame]:
    requests = _requests_with_vectors(spark, sf)
    records = read_spread(spark, sf, "documents")
    hits = recommend.recommend_by_vector(
        requests, records, DOCUMENT_COLUMNS, query_col="item_id",
        vectors=_vectors(records, "doc_id", "text"),
    )
    return requests, hits


@query
def recommend_vector(spark, sf):
    return _nearest_documents(spark, sf)[1].select(
        "item_id", "rank", "doc_id", "score", joined("matched_keywords").alias("matched")
    )


@query
def recommend_documents(spark, sf):
    requests, hits = _nearest_documents(spark, sf)
    results = recommend.result_documents(
        requests, hits, DOCUMENT_COLUMNS, query_col="item_id", prompt_col="text"
    )
    first = "$.recommendations[0]"
    return results.select(
        "item_id",
        F.col("total").cast("long").alias("total"),
        F.get_json_object("document", f"{first}.docId").cast("long").alias("first_doc"),
        F.get_json_object("document", f"{first}.score").cast("double").alias("first_score"),
    )


@query
def recommend_keyword(spark, sf):
    hits = recommend.recommend_by_keywords(
        _requests(spark, sf), read_spread(spark, sf, "part"), PART_COLUMNS,
        query_col="item_id", prompt_col="text",
    )
    return hits.select(
        "item_id", "rank", "p_partkey", "score", joined("matched_keywords").alias("matched"),
    )


def _short_texts_only(model, limit: int):
    """A model that fails on texts longer than ``limit``, as real ones do."""

    def factory():
        run = model()

        def embed(texts):
            if any(len(t) > limit for t in texts):
                raise ValueError("text too long")
            return run(texts)

        return embed

    return factory


@query
def recommend_routed(spark, sf):
    """Prompts the model refuses take the keyword path."""
    refusing = _short_texts_only(embedding.hashed_terms(SIZE), 200)
    requests = _requests_with_vectors(spark, sf, refusing)
    part = read_spread(spark, sf, "part")
    content = tx.embedding_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    hits = recommend.recommend(
        requests, part, PART_COLUMNS, query_col="item_id", prompt_col="text",
        vectors=_vectors(part.withColumn("content", content), "p_partkey", "content"),
    )
    table = recommend.numbered_table(hits, name_col="p_name", name_chars=8)
    return table.select(
        "item_id", "path", "number", "p_partkey", "short_name", "score_text"
    )


# --- upsert ----------------------------------------------------------------------------


def part_batch(part: DataFrame) -> DataFrame:
    """A batch over all parts: changed, empty, blank and illegal cells, new and blank keys."""
    size = F.col("p_size")
    return part.select(
        (F.col("p_partkey") + 2).alias("row_no"),
        F.when(size == 50, F.lit("  "))
        .when(size == 49, (F.col("p_partkey") + 100_000_000_000).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
        .alias("p_partkey"),
        F.when(size <= 5, F.concat("p_name", F.lit(" mk2")))
        .when(size <= 10, F.lit(None))
        .when(size <= 12, F.lit(" \t"))
        .otherwise(F.concat("p_name", F.lit(" ")))
        .alias("p_name"),
        F.when(size.between(13, 15), F.lit(None))
        .when(size.between(16, 18), F.lit("  "))
        .when(size.between(19, 22), F.lit("Brand#99"))
        .when(size.between(23, 24), F.lit("Brand#too long"))
        .otherwise(F.col("p_brand"))
        .alias("p_brand"),
        F.when(size.between(25, 27), F.lit("BAD")).otherwise(F.col("p_type")).alias("p_type"),
    )


def _part_changes(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = read_table(spark, sf, "part")
    return part, upsert.upsert_changes(part, part_batch(part), PART_UPSERT)


@query
def upsert_changes(spark, sf):
    changes = _part_changes(spark, sf)[1]
    return changes.select(
        "row_no",
        F.coalesce("p_partkey", F.lit("")).alias("p_partkey"),
        "action",
        F.array_join("changed_fields", "; ").alias("changed"),
        F.array_join("errors", "; ").alias("errors"),
    )


@query
def upsert_merged(spark, sf):
    part, changes = _part_changes(spark, sf)
    base = part.withColumns({"created_at": F.lit(0).cast("long"), "updated_at": F.lit(0).cast("long")})
    return upsert.merged_records(
        base, changes, PART_UPSERT, run_time=F.lit(1).cast("long"),
        created_col="created_at", updated_col="updated_at",
    )


def _part_run(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A whole upsert run over parts with old vectors; long texts can't be embedded."""
    part = read_table(spark, sf, "part")
    base = part.withColumn("embedding", F.array(F.lit(-1.0).cast("float")))
    return upsert.upserted(
        base, part_batch(part), PART_UPSERT, text_cols=["p_name", "p_brand", "p_type"],
        model=_short_texts_only(embedding.hashed_terms(64), 26), size=64,
    )


@query
def upsert_reembedded(spark, sf):
    after = _part_run(spark, sf)[0]
    return after.select(
        "p_partkey",
        F.aggregate(
            F.coalesce("embedding", F.array().cast("array<float>")), F.lit(0.0),
            lambda s, x: s + x.cast("double"),
        ).cast("long").alias("n_tokens"),
        F.coalesce("embed_error", F.lit("")).alias("embed_error"),
    )


@query
def upsert_summary(spark, sf):
    """Summary, counts, and every inserted, updated and failed row with its id and errors."""
    return _part_run(spark, sf)[1].select(
        "section", F.coalesce("row_no", F.lit(0).cast("long")).alias("row_no"),
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("message", F.lit("")).alias("message"), "n",
    )


def repeated_batch(part: DataFrame) -> DataFrame:
    """Three rows per part in turn: rename, empty cells with a new brand, name again."""
    step = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("step")
    rows = part.select("*", step)
    key = F.col("p_partkey") + F.when(F.col("p_size") > 45, 100_000_000_000).otherwise(0)
    return rows.select(
        (F.col("p_partkey") * 3 + F.col("step") + 2).alias("row_no"),
        key.cast("string").alias("p_partkey"),
        F.when(F.col("step") == 0, F.concat("p_name", F.lit(" x")))
        .when(F.col("step") == 1, F.lit(None))
        .when(F.col("p_size") < 20, F.concat("p_name", F.lit(" x")))
        .otherwise(F.col("p_name"))
        .alias("p_name"),
        F.when(F.col("step") == 0, F.col("p_brand"))
        .when(F.col("step") == 1, F.lit("Brand#7"))
        .when(F.col("p_size") < 10, F.lit("Brand#7"))
        .alias("p_brand"),
    )


@query
def upsert_repeated_keys(spark, sf):
    part = read_table(spark, sf, "part")
    changes = upsert.upsert_changes(part, repeated_batch(part), PART_UPSERT)
    return changes.select(
        "row_no", "p_partkey", "action", F.array_join("changed_fields", "; ").alias("changed")
    )


@query
def upsert_repeated_merged(spark, sf):
    part = read_table(spark, sf, "part")
    changes = upsert.upsert_changes(part, repeated_batch(part), PART_UPSERT)
    return upsert.merged_records(part, changes, PART_UPSERT).select(
        "p_partkey", "p_name", "p_brand", "p_size"
    )


@query
def batch_append(spark, sf):
    """Append supplier keys to the part keys; known and repeated keys are rejected."""
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    items = read_table(spark, sf, "lineitem").select(
        (F.col("l_partkey") + F.col("l_linenumber") * 1000).alias("key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    fits, rejected = upsert.append_new(part, items, key_col="key", order_col="seq")
    return fits.withColumn("fits", F.lit(True)).unionByName(
        rejected.withColumn("fits", F.lit(False))
    ).groupBy("key", "fits").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query
def batch_delete(spark, sf):
    keys = read_table(spark, sf, "labels").select("doc_id")
    docs = read_table(spark, sf, "documents")
    return upsert.delete_keys(docs, keys, key_col="doc_id").select("doc_id", "lang", "n_chars")


@query
def batch_overwrite(spark, sf):
    """Set language and source of the labelled documents from their labels."""
    items = read_table(spark, sf, "labels").select(
        "doc_id",
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"),
        F.lit(None).cast("string").alias("source"),
    )
    docs = read_table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.lit(0).cast("long").alias("updated_at")
    )
    return upsert.overwrite_fields(
        docs, items, key_col="doc_id", fields=["lang", "source"], updated_col="updated_at",
        run_time=F.lit(1).cast("long"),
    )


@query
def record_rules(spark, sf):
    """Violated rules per part."""
    part = read_table(spark, sf, "part")
    rules = {
        "p_name": {"longer than 9": upsert.max_length(9)},
        "p_type": {"not allowed": upsert.one_of(["SMALL", "LARGE", "PROMO"])},
    }
    values = {"p_name": F.col("p_name"), "p_type": F.col("p_type")}
    failed = upsert.failed_rules(values, rules)
    return part.select("p_partkey", F.array_join(failed, "; ").alias("failed"))


# --- chat ------------------------------------------------------------------------------


@query
def intent_route(spark, sf):
    turns = read_table(spark, sf, "conversations").filter("role = 'user'")
    length = F.length("text")
    message = F.when(length < 40, F.lit(" ")).otherwise(F.col("text"))
    return turns.select(
        "conv_id", "turn",
        chat.route(message, F.coalesce(length < 100, F.lit(False)), length > 350).alias("route"),
    )


@query
def request_validation(spark, sf):
    turns = read_table(spark, sf, "conversations").filter("role = 'user'")
    length = F.length("text")
    message = F.when(length < 60, F.lit("\t ")).otherwise(F.col("text"))
    asked = (F.col("turn") * 5 - 5).cast("int")
    return turns.select(
        "conv_id", "turn",
        F.coalesce(
            chat.request_problem(message, has_file=length < 40, limit=asked), F.lit("")
        ).alias("problem"),
        tx.clamp_limit(asked).alias("result_limit"),
    )


@query
def tool_args(spark, sf):
    """A log of tool calls: known, unknown and missing names, arguments of every shape."""
    events = read_table(spark, sf, "events")
    kind, user, number = F.col("event_type"), F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string")
    name = (
        F.when(kind == "purchase", "update_projects_from_excel").when(kind == "error", F.concat(F.lit("find"), number))
        .when(kind != "signup", "recommend_projects")
    )
    raw = (
        F.when((kind == "error") | (F.col("event_id") % 7 == 0), F.concat(F.lit("find "), "props"))
        .when(kind == "click", F.concat(F.lit('{"query": ["click", '), user, F.lit('], "max_results": "'), number, F.lit('"}')))
        .when((kind == "view") & (F.col("event_id") % 3 == 0), F.concat(F.lit('{"query": '), user, F.lit(', "max_results": '), number, F.lit(".75}")))
        .when(kind == "view", F.lit('{"query": "seen", "max_results": "many"}'))
        .when(kind == "purchase", F.concat(F.lit('{"file_path": "/in/'), number, F.lit('.xlsx", "query": null}')))
        .otherwise(F.col("props"))
    )
    calls = events.select("event_id", chat.tool_call(name, raw).alias("call"))
    return calls.select("event_id", *[F.coalesce(f"call.{c}", F.lit("")).alias(c) for c in ("name", "query", "file_path", "reply")],
                        F.coalesce("call.max_results", F.lit(-1)).alias("max_results"))


def _windows(spark, sf, size):
    turns = read_table(spark, sf, "conversations")
    windows = chat.history_windows(
        turns, conversation_col="conv_id", turn_col="turn", size=size
    )
    context = F.when(F.col("role") == "assistant", F.lit("found"))
    messages = chat.prompt_messages(
        F.lit("be brief"), F.col("history"), F.col("text"), context
    )
    line = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|"
    )
    return windows.withColumn("messages", messages).select(
        "conv_id", "turn", F.size("messages").cast("long").alias("n_messages"),
        F.md5(line).alias("messages_md5"),
    )


@query
def context_window(spark, sf):
    return _windows(spark, sf, 10)


@query
def context_window_short(spark, sf):
    return _windows(spark, sf, 3)


# --- sources and sinks -----------------------------------------------------------------


@query
def json_result(spark, sf):
    names = {"o_orderkey": "orderKey", "o_orderstatus": "orderStatus", "o_orderpriority": "priority"}
    orders = tables.renamed(read_table(spark, sf, "orders"), names)
    return tables.as_json(orders, list(names.values())).select("orderKey", "json")


@query
def batch_files(spark, sf):
    """Parts in delimited files of three headers and one that can't be used, read as a batch."""
    folder = tables.new_folder(spark, "batch-files")
    part = read_table(spark, sf, "part")
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    headers = [
        [key.alias(" Project_Code"), name.alias("PROJECT_NAME "), kind.alias("Kind")],
        [kind.alias("KIND"), name.alias("project_name"), key.alias("Project_Code ")],
        [name.alias("Project_Name"), key.alias("project_code")],
        [kind.alias("kind"), name.alias("project_name")],
    ]
    for number, columns in enumerate(headers):
        rows = part.filter(key % 4 == number).coalesce(1 if number == 3 else 2)
        rows.select(*columns).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{folder}/{number}")
    rows, problems = batches.read_delimited(spark, f"{folder}/*")
    return rows.select(
        "project_code", "project_name", F.coalesce("kind", F.lit("")).alias("kind"),
        joined(F.array_sort("present")).alias("present"), F.lit("").alias("problem"),
    ).unionByName(
        problems.select(
            *[F.lit("").alias(c) for c in ("project_code", "project_name", "kind", "present")], "problem"
        )
    )
