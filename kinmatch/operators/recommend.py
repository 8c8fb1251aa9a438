"""Recommendation: nearest records per request, explained, as one result per request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.operators.keyword_score import nearest_by_keywords
from kinmatch.operators.vector_search import _nearest_batch
from kinmatch.sources.tables import settled


@dataclass(frozen=True)
class RecordColumns:
    """Names of the record columns the pipeline uses."""

    key: str
    # compared with keywords; the title's brackets separate words
    title: str | None
    match: Sequence[str]
    # scored without vectors, in this order
    score: Sequence[str]
    vector: str = "embedding"
    newest: str | None = None
    # shown in results: column -> name
    shown: Mapping[str, str] = None
    # column whose fixed prefix is dropped when shown
    summary: str | None = None


def prepared_requests(
    requests: DataFrame,
    *,
    query_col: str,
    prompt_col: str,
    limit_col: str | None = None,
    keywords_col: str | None = None,
    default_limit: int = fixed.DEFAULT_RESULTS,
) -> DataFrame:
    """Requests with ``extracted`` keywords, ``keywords`` to match and a clamped ``limit``.

    Given keywords win over extracted ones when there are any. Blank prompts and negative
    limits get a ``problem`` and no limit.
    """
    requested = F.col(limit_col) if limit_col else F.lit(None).cast("int")
    extracted = requests.withColumn("extracted", tx.keywords(F.col(prompt_col), 10))
    given = F.col(keywords_col) if keywords_col else F.lit(None).cast("array<string>")
    problem = F.when(tx.is_blank(F.col(prompt_col)), "blank message").when(
        F.col("limit").isNull(), "negative limit"
    )
    return (
        extracted.withColumn(
            "keywords", F.when(F.size(given) > 0, given).otherwise(F.col("extracted"))
        )
        .withColumn("limit", tx.clamp_limit(requested, default_limit))
        .withColumn("problem", problem)
    )


def _explained(hits, requests, records, columns: RecordColumns, query_col, small) -> DataFrame:
    """Hits within each request's limit, with record columns and matched keywords.

    ``small`` says the hits are proven few; then records are streamed past them.
    """
    facts = requests.select(query_col, "keywords", "limit")
    kept = hits.join(facts, query_col).filter(F.col("rank") <= F.col("limit"))
    shown = list(columns.shown or {})
    needed = list(dict.fromkeys([columns.key, columns.title, *columns.match, *shown]))
    wanted = records.select(*[c for c in needed if c])
    title = F.col(columns.title) if columns.title else None
    words = tx.searchable_text(title, [F.col(c) for c in columns.match])
    return (
        wanted.join(F.broadcast(kept) if small else kept, columns.key)
        .withColumn("matched_keywords", tx.matched_keywords(F.col("keywords"), words))
        .select(query_col, "rank", *wanted.columns, "score", "matched_keywords")
    )


def recommend_by_vector(
    requests: DataFrame, records: DataFrame, columns: RecordColumns, *, query_col: str,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Nearest records of prepared requests that have a vector, explained.

    ``vectors`` may hold the record vectors by key, apart from ``records``.
    """
    hits, small = _nearest_batch(
        requests, records if vectors is None else vectors, query_col=query_col,
        key_col=columns.key,
        vector_col=columns.vector, k=fixed.MAX_RESULTS,
    )
    hits = hits.select(query_col, "rank", columns.key, "score")
    return _explained(hits, requests, records, columns, query_col, small)


def recommend_by_keywords(
    requests: DataFrame, records: DataFrame, columns: RecordColumns, *, query_col: str,
    prompt_col: str,
) -> DataFrame:
    """Best records by keyword and fuzzy score, explained."""
    hits = nearest_by_keywords(
        requests, records, query_col=query_col, prompt_col=prompt_col, keywords_col="keywords",
        key_col=columns.key, score_cols=columns.score, order_col=columns.newest,
    )
    return _explained(hits, requests, records, columns, query_col, small=False)


def recommend(
    requests: DataFrame, records: DataFrame, columns: RecordColumns, *, query_col: str,
    prompt_col: str, vectors: DataFrame | None = None,
) -> DataFrame:
    """By vector for requests that have one, by keywords for the others; ``path`` says which.

    Requests are stored with their vectors first, and both branches read what is stored: a
    model that answers differently when asked again neither loses nor doubles a request.
    """
    valid = settled(requests.filter(F.col("problem").isNull()), "routed-requests")
    with_vector = valid.filter(F.col(columns.vector).isNotNull())
    without = valid.filter(F.col(columns.vector).isNull())
    near = recommend_by_vector(
        with_vector, records, columns, query_col=query_col, vectors=vectors
    )
    scored = recommend_by_keywords(
        without, records, columns, query_col=query_col, prompt_col=prompt_col
    )
    return near.withColumn("path", F.lit("vector")).unionByName(
        scored.withColumn("path", F.lit("keyword"))
    )


def result_documents(
    requests: DataFrame, hits: DataFrame, columns: RecordColumns, *, query_col: str,
    prompt_col: str,
) -> DataFrame:
    """One row per request: (query, total, document) with a nested JSON document.

    A request holds at most ten hits, so collecting them per request stays small.
    Requests without hits keep a row with the fixed message.
    """
    shown = []
    for name, label in (columns.shown or {}).items():
        value = F.col(name)
        if name == columns.summary:
            value = tx.without_prefix(F.coalesce(value, F.lit("")))
        shown.append(value.alias(label))
    item = F.struct(
        "rank",
        F.struct(
            *shown,
            tx.two_decimals(F.col("score")).alias("score"),
            F.col("matched_keywords").alias("matchedKeywords"),
        ).alias("item"),
    )
    lists = hits.groupBy(query_col).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    item_type = lists.schema["_items"].dataType
    items = F.transform(
        F.coalesce("_items", F.array().cast(item_type)), lambda i: i["item"]
    )
    document = F.struct(
        F.col(prompt_col).alias("query"),
        F.col("extracted").alias("extractedKeywords"),
        F.size(items).alias("totalResults"),
        items.alias("recommendations"),
        F.when(F.size(items) == 0, fixed.NO_RESULT_MESSAGE).alias("message"),
    )
    return requests.join(lists, query_col, "left").select(
        query_col,
        F.size(items).alias("total"),
        F.coalesce("problem", F.to_json(document)).alias("document"),
    )


def numbered_table(hits: DataFrame, *, name_col: str, name_chars: int = 20) -> DataFrame:
    """Hits as shown in a table: number, shortened name, the rounded score as text."""
    return hits.withColumns(
        {
            "number": F.col("rank"),
            "short_name": tx.ellipsis(F.col(name_col), name_chars),
            "score_text": tx.two_decimal_text(tx.two_decimals(F.col("score"))),
        }
    )
