"""Exact duplicates by a streaming job with disk-backed keyed state.

Documents become a log of digests (id, digest of the normalised text, length, locator). A
Structured Streaming query reads the log and keeps, for each digest and without expiry, the
row that stays and a count, in RocksDB state with its checkpoint in the shared folder. A caller
that names the folder adds a table to the same log and state, run by run. Digest hits are then
checked on full bytes: the text that a state's locator names is compared with each text that
hit it.

Texts are equal when identical after deleting ASCII white space. Of equal texts the row with
the most code points stays, then the one with the smallest id.

Defined cases: null counts as an empty text, all empty texts are equal; a null id comes after
all others and its rows stand as any; rows repeated in full have one keep_id, and one of them
is marked kept; texts of one digest that differ (a collision) form groups of their own; an
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmatch.llm.shared import fresh, new_folder, settled, small

#: State on disk; without preallocation, which takes 4 MB for each of many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest_log(documents: DataFrame, folder: str, id_col: str, text_col: str, run: int = 0) -> None:
    """Append a table's digests to the log; a row's run and place are fixed by being written."""
    documents.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        F.struct(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("place")).alias("row"),
    ).write.mode("append").parquet(folder)


def runs_so_far(spark: SparkSession, log: str) -> int:
    """How many tables a log holds; none where there is no log yet."""
    try:
        last = spark.read.parquet(log).agg(F.max("row.run")).first()[0]
    except AnalysisException:
        return 0
    return 0 if last is None else last + 1


def rank() -> Column:
    """Orders equal texts; the smallest stays. It also locates the content: id, length, row."""
    return F.struct(
        (-F.col("points")).alias("points"), F.col("id").isNull().alias("unnamed"), "id", "row"
    )


def keyed_state(log: str, checkpoint: str, changes: str, documents: DataFrame) -> DataFrame:
    """Run the stream over what the log has gained; ``(digest, best, group_size)``."""
    spark = documents.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(log).schema
        best = (
            spark.readStream.schema(schema)
            .parquet(log)
            .groupBy("digest")
            .agg(F.min(rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            best.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{changes}/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # A digest is written again whenever it changes; its last state has the most rows.
    return (
        spark.read.schema(best.schema)
        .parquet(f"{changes}/batch=*")
        .groupBy("digest")
        .agg(F.min("best").alias("best"), F.max("group_size").alias("group_size"))
    )


def groups(
    documents: DataFrame, id_col="doc_id", text_col="text", home: str | None = None, new: DataFrame | None = None
) -> DataFrame:
    """``(id, digest, points, row, keep, keep_row, group_size, part)`` for every row.

    ``part`` is null unless a digest stands for several texts; then it is the text's own
    longer digest and the group is cut by it. With ``home``, a folder of the caller, its log and
    state go on: ``new`` holds the rows to add, ``documents`` all rows so far, whose bytes are
    compared; the result covers all rows of the log.
    """
    spark = documents.sparkSession
    home = home or new_folder(spark, "exact-dedup")
    run = runs_so_far(spark, f"{home}/log")
    digest_log(documents if new is None else new, f"{home}/log", id_col, text_col, run)
    state = keyed_state(f"{home}/log", f"{home}/state", f"{home}/changes", documents)
    state = settled(
        state.select("digest", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "group_size"),
        "groups",
    )
    log = spark.read.parquet(f"{home}/log")
    rows = log.join(state, "digest")
    clashes = settled(collisions(documents, state, id_col, text_col), "collisions")
    if clashes.isEmpty():
        return rows.withColumn("part", F.lit(None).cast("string"))
    return split_collisions(documents, rows, clashes, id_col, text_col)


def collisions(documents: DataFrame, state: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests under which a text differs from the kept one, byte by byte."""
    hits = state.where("group_size > 1").select("digest", "keep")
    texts = documents.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    texts = texts.withColumn("digest", F.sha2("body", 256))
    met = texts.join(small(hits, hits.count()), "digest")
    kept = met.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest").agg(F.min("body").alias("kept_body"))
    return met.join(kept, "digest").where("body != kept_body").select("digest").distinct()


def split_collisions(documents: DataFrame, rows: DataFrame, clashes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts under a digest in ``clashes`` are told apart by a second, longer digest."""
    texts = documents.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("body"))
    texts = (
        texts.withColumn("digest", F.sha2("body", 256))
        .join(clashes, "digest", "left_semi")
        .select(F.col("digest").alias("_digest"), "_id", F.sha2("body", 512).alias("part"))
        .distinct()
    )
    parts = rows.join(
        texts, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest")), "left"
    ).drop("_id", "_digest")
    best = parts.where("part IS NOT NULL").groupBy("part").agg(F.min(rank()).alias("best"), F.count(F.lit(1)).alias("n"))
    own = F.col("best").isNotNull()  # whose id can be null
    return parts.join(best, "part", "left").select(
        "id", "digest", "points", "row", F.when(own, F.col("best.id")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("best.row", "keep_row").alias("keep_row"), F.coalesce("n", "group_size").alias("group_size"), "part",
    )


def exact_groups(
    documents: DataFrame, id_col="doc_id", text_col="text", home: str | None = None, new: DataFrame | None = None
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. See ``groups``."""
    return groups(documents, id_col, text_col, home, new).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def first_copies(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay, with their own columns only.

    Dropped rows are taken out by id and digest, so the texts are shuffled only where the
    dropped ids are too many to broadcast. A row that is repeated in full, id included, comes
    out of a small separate branch.
    """
    found = groups(documents, id_col, text_col)
    names = documents.columns
    key, mark = fresh(documents, "_digest"), fresh(documents, "_drop")
    per_key = found.groupBy("id", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("row") == F.col("keep_row")).cast("int")).alias("keeps")
    )
    odd = settled(per_key.where("keeps = 0 OR n > 1"), "dropped")
    odd = small(odd.select(F.col("id").alias("_id"), F.col("digest").alias("_of"), F.col("keeps").alias(mark)), odd.count())
    rows = documents.withColumn(key, F.sha2(normalised(F.col(text_col)), 256))
    rows = rows.join(odd, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_of")), "left")
    single = rows.where(F.col(mark).isNull()).select(names)
    order = Window.partitionBy(id_col, key).orderBy(F.length(text_col).desc_nulls_last())
    repeated = rows.where(F.col(mark) == 1).withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1)
    return single.unionByName(repeated.select(names))
