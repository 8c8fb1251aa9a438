"""From raw documents to sampled pieces: five stages, each written before the next one reads it.

Quality rules reject documents, exact copies go, of near copies one stays, sources are mixed to
their targets (a document can then occur up to three times), and texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import exact_dedup, mixing, ngram_jaccard, pieces, quality_rules
from kinmatch.llm.queries import MODEL_FILE
from kinmatch.llm.shared import fresh, new_folder, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The models are fitted on this stage's own documents."""
    ratios = quality_rules.log_ratios(docs, read_table(spark, sf_dir, "labels"))
    verdict = fresh(docs, "_verdict")
    judged = docs.withColumn(verdict, quality_rules.verdict(F.col("text"), ratios))
    return judged.where(F.col(verdict)["kept"]).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays."""
    return exact_dedup.first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 similar shingles, the one with the smallest id stays."""
    return ngram_jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it was drawn."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of texts, each checked to decode to its text."""
    words = pieces.Vocabulary(MODEL_FILE)
    coded = pieces.encoded(docs.select("doc_id", "source", "lang", "text"), words, lossless_col="lossless")
    return coded.select(
        "doc_id", "source", "lang", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless"
    )


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("pieces", encode),
]
#: Sampled copies and segmentations can't be said in SQL; stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
