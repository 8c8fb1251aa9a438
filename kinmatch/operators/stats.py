"""Distributions over a record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n) per value; NULL is a value of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def domain_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(column, n) for exactly the values of ``domain``, zero when absent."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = category_counts(df.filter(F.col(column).isin(list(domain))), column)
    # at most len(domain) rows on either side
    return values.join(F.broadcast(counts), column, "left").select(
        column, F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def record_stats(
    df: DataFrame, *, category_col: str, domain_col: str, domain: Sequence[str],
    vector_col: str = "embedding",
) -> DataFrame:
    """All statistics in long form: (metric, value, n), in one scan of the table.

    One grouping counts per category, per domain value and in all. Metrics that must be there
    without rows, and domain values that don't occur, come from a constant row of zeros.
    """

    def line(metric, value, n):
        return F.struct(metric.alias("metric"), value.alias("value"), n.alias("n"))

    def lines(pairs):
        return F.array(*[line(F.lit(m), F.lit(v).cast("string"), F.lit(0).cast("long")) for m, v in pairs])

    category, value = F.col("_category"), F.col("_domain")
    n, filled = F.col("_n"), F.col("_filled")
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(category_col).cast("string").alias("_category"),
        F.col(domain_col).cast("string").alias("_domain"),
        F.col(vector_col).isNotNull().alias("_has_vector"),
    )
    counted = rows.groupingSets([[category], [value], []], category, value).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_has_vector").alias("_filled"),
        F.grouping_id().alias("_set"),
    )
    # bits of the set: category left out, domain value left out
    said = (
        F.when(F.col("_set") == 1, F.array(line(F.lit("category"), category, n)))
        .when(F.col("_set") == 2, F.array(line(F.lit("domain"), value, n)))
        .otherwise(
            F.array(
                line(F.lit("total"), none, n), line(F.lit("with_embedding"), none, filled),
                line(F.lit("without_embedding"), none, n - filled),
            )
        )
    )
    outside = (F.col("_set") == 2) & ~F.coalesce(value.isin(list(domain)), F.lit(False))
    zeros = [(m, None) for m in ("total", "with_embedding", "without_embedding")]
    zeros += [("domain", v) for v in domain]
    constant = df.sparkSession.range(1).select(F.explode(lines(zeros)).alias("_line"))
    return (
        counted.filter(~outside).select(F.explode(said).alias("_line"))
        .unionByName(constant)
        .groupBy(F.col("_line.metric").alias("metric"), F.col("_line.value").alias("value"))
        .agg(F.sum("_line.n").alias("n"))
    )


def stats_document(stats: DataFrame) -> DataFrame:
    """``record_stats`` as one JSON document, for columns with a small set of values.

    NULL and the text ``null`` are one key, with the sum of both counts.
    """
    stats = stats.groupBy("metric", F.coalesce("value", F.lit("null")).alias("value")).agg(F.sum("n").alias("n"))

    def distribution(metric):
        pairs = F.collect_list(
            F.when(
                F.col("metric") == metric,
                F.struct(F.col("value").alias("key"), F.col("n").alias("value")),
            )
        )
        return F.map_from_entries(F.sort_array(pairs))

    def total(metric):
        return F.sum(F.when(F.col("metric") == metric, F.col("n")))

    return stats.agg(
        F.to_json(
            F.struct(
                total("total").alias("totalProjects"),
                total("with_embedding").alias("withEmbedding"),
                total("without_embedding").alias("withoutEmbedding"),
                distribution("category").alias("industryDistribution"),
                distribution("domain").alias("gradeDistribution"),
            )
        ).alias("document")
    )
