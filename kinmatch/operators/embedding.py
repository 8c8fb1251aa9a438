"""Text embedding: pluggable model, content-addressed store, incremental backfill.

A model is a *factory*: called once per task, it returns a function from a list of
non-blank texts to a list (or matrix) of vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed
from kinmatch.functions import text as tx
from kinmatch.operators.blocks import tidied
from kinmatch.sources.tables import settled

Model = Callable[[list[str]], Sequence]
# Places of tokens that a task remembers: about 10 MB.
PLACES = 1 << 16
# Keys of missing texts, with their hashes, that are broadcast: about 20 MB.
BROADCAST_KEYS = 1 << 17


def hashed_terms(size: int = fixed.EMBEDDING_SIZE) -> Callable[[], Model]:
    """Offline default model: token counts in ``size`` hashed places.

    A token's place is the first 32 bits of its MD5 modulo ``size``. Values are whole
    numbers, so cosines of these vectors do not depend on the order of addition.
    """
    # Java's Nd class is Python's \d
    pattern = re.compile(fixed.TOKEN_PATTERN.replace(r"\p{Nd}", r"\d"))

    def factory() -> Model:
        class Places(dict):
            def __missing__(self, token: str) -> int:
                digest = hashlib.md5(token.encode()).digest()
                place = self[token] = int.from_bytes(digest[:4], "big") % size
                return place

        places = Places()

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), dtype=np.float32)
            if len(places) > PLACES:
                places.clear()
            for row, content in zip(out, texts):
                found = [places[token] for token in pattern.findall(content.lower())]
                if found:
                    row[:] = np.bincount(found, minlength=size)
            return out

        return embed

    return factory


def _resize(vector, size: int) -> np.ndarray:
    values = list(vector.values()) if isinstance(vector, dict) else vector
    fixed_size = np.zeros(size, dtype=np.float32)
    values = np.asarray(values, dtype=np.float32)[:size]
    fixed_size[: len(values)] = values
    return fixed_size


def _embed_texts(model: Model, texts: list[str], size: int) -> tuple[list, list]:
    """Vectors and errors, one of each per text; a failing text does not hurt the others.

    A failed call is repeated on its halves, so one bad text among n costs 2 log2 n calls more.
    """
    try:
        result = model(texts)
        if len(result) != len(texts):
            raise ValueError(f"{len(result)} vectors for {len(texts)} texts")
        return [_resize(v, size) for v in result], [None] * len(texts)
    except Exception as problem:
        if len(texts) == 1:
            return [None], [str(problem)]
    half = len(texts) // 2
    parts = [_embed_texts(model, part, size) for part in (texts[:half], texts[half:])]
    return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]


def embed(
    df: DataFrame,
    *,
    key_col: str,
    text_col: str,
    model: Callable[[], Model] | None = None,
    size: int = fixed.EMBEDDING_SIZE,
    rows_per_call: int = 1024,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, embedding, error) per row. Blank text gives no vector but an error.

    Vectors are padded or cut to ``size``. Rows stay where they are: no shuffle. Columns in
    ``keep`` come along, which saves joining the vectors back.
    """
    factory = model or hashed_terms(size)
    key_type = df.schema[key_col].dataType.simpleString()
    schema = f"{key_col} {key_type}, embedding array<float>, error string"
    for name in keep:
        schema += f", `{name}` {df.schema[name].dataType.simpleString()}"

    def embed_batches(batches):
        run = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_call):
                part = batch.slice(start, rows_per_call)
                texts = part.column(1).to_pylist()
                filled = [i for i, content in enumerate(texts) if content]
                vectors: list = [None] * len(texts)
                errors: list = ["blank text cannot be embedded"] * len(texts)
                if filled:
                    done = _embed_texts(run, [texts[i] for i in filled], size)
                    for i, vector, error in zip(filled, *done):
                        vectors[i], errors[i] = vector, error
                present = [v for v in vectors if v is not None]
                flat = np.concatenate(present) if present else np.zeros(0, np.float32)
                ends = np.cumsum([0] + [0 if v is None else size for v in vectors])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat, pa.float32()),
                    mask=pa.array([v is None for v in vectors]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(errors, pa.string()), *part.columns[2:]],
                    names=[key_col, "embedding", "error", *keep],
                )

    text = tx.strip(F.coalesce(text_col, F.lit(""))).alias("_content")
    trimmed = df.select(key_col, text, *keep)
    return trimmed.mapInArrow(lambda batches: tidied(embed_batches(batches)), schema)


# --- content-addressed store: (text_sha, embedding) -------------------------------


def content_key(text: Column) -> Column:
    """SHA-256 of the trimmed text."""
    return F.sha2(tx.strip(text), 256)


def texts_not_stored(
    df: DataFrame, store: DataFrame, *, text_col: str, key_col: str | None = None
) -> DataFrame:
    """Distinct non-blank texts without a stored vector: (text_sha, text).

    With ``key_col``, which names a row and is never NULL, only keys and hashes are shuffled
    against the store. One key stands for each missing text, and texts are fetched for those
    keys alone.
    """
    content = F.col(text_col)
    filled = df.filter(~tx.is_blank(content))
    known = store.select("text_sha")
    if key_col is None:
        distinct = (
            filled.select(content_key(content).alias("text_sha"), tx.strip(content).alias("text"))
            .groupBy("text_sha")
            .agg(F.any_value("text").alias("text"))
        )
        return distinct.join(known, "text_sha", "left_anti")
    missing = (
        filled.groupBy(content_key(content).alias("text_sha"))
        .agg(F.min(key_col).alias("_key"))
        .join(known, "text_sha", "left_anti")
    )
    # stored, so that its size is known when the join to the texts is planned
    missing = settled(missing, "missing-texts")
    texts = df.select(F.col(key_col).alias("_key"), tx.strip(content).alias("text"))
    if missing.count() <= BROADCAST_KEYS:
        # what is missing may lie in a few files; the model is the costly part
        return texts.join(F.broadcast(missing), "_key").select("text_sha", "text").hint("rebalance")
    return texts.join(missing, "_key").select("text_sha", "text")


def new_store_rows(
    df: DataFrame, store: DataFrame, *, text_col: str, key_col: str | None = None, model=None,
    size: int = fixed.EMBEDDING_SIZE,
) -> DataFrame:
    """Vectors for the texts the store lacks: (text_sha, embedding, error)."""
    missing = texts_not_stored(df, store, text_col=text_col, key_col=key_col)
    return embed(missing, key_col="text_sha", text_col="text", model=model, size=size)


def with_stored_vectors(df: DataFrame, store: DataFrame, *, text_col: str) -> DataFrame:
    """Rows with the stored vector of their text in ``embedding``, NULL without one.

    The store has one row per text; a text shared by many rows only makes the row side
    uneven, which adaptive execution splits.
    """
    keyed = df.withColumn("_sha", content_key(F.col(text_col)))
    vectors = store.select(F.col("text_sha").alias("_sha"), "embedding")
    return keyed.join(vectors, "_sha", "left").drop("_sha")


def store_stats(df: DataFrame, store: DataFrame, *, text_col: str) -> DataFrame:
    """One row: lookups, hits, misses, hit_rate. A repeat of a missing text is a hit."""
    content = F.col(text_col)
    per_text = (
        df.filter(~tx.is_blank(content))
        .groupBy(content_key(content).alias("text_sha"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stored = store.select("text_sha").distinct().withColumn("known", F.lit(True))
    totals = per_text.join(stored, "text_sha", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"),
        F.count_if(F.col("known").isNull()).alias("misses"),
    )
    hits = F.col("lookups") - F.col("misses")
    rate = F.when(
        F.col("lookups") > 0, F.format_string("%.1f%%", hits / F.col("lookups") * 100)
    ).otherwise("N/A")
    return totals.select("lookups", hits.alias("hits"), "misses", rate.alias("hit_rate"))


# --- status and backfill -----------------------------------------------------------


def embedding_status(df: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    n, filled = F.count(F.lit(1)), F.count(vector_col)
    return df.agg(
        n.alias("total"),
        filled.alias("with_embedding"),
        (n - filled).alias("without_embedding"),
    )


def without_embedding(
    df: DataFrame, *, vector_col: str = "embedding", order_col: str | None = None, key_col: str
) -> DataFrame:
    """Rows lacking a vector, newest first when there is an order column."""
    missing = df.filter(F.col(vector_col).isNull())
    order = [F.desc(order_col)] if order_col else []
    return missing.orderBy(*order, key_col)


def attach_vectors(
    df: DataFrame, new: DataFrame, *, key_col: str, vector_col: str = "embedding",
    updated_col: str | None = None, run_time: Column | None = None,
) -> DataFrame:
    """Set vectors by key; ``updated_col`` moves to ``run_time`` where one was set.

    A null vector, as a failed embedding gives, changes nothing.
    """
    incoming = new.select(key_col, F.col(vector_col).alias("_new"))
    joined = df.join(incoming.where("_new IS NOT NULL"), key_col, "left")
    columns = {vector_col: F.coalesce("_new", vector_col)}
    if updated_col:
        columns[updated_col] = F.when(F.col("_new").isNotNull(), run_time).otherwise(F.col(updated_col))
    return joined.withColumns(columns).drop("_new").select(df.columns)


def backfill(
    df: DataFrame, *, key_col: str, text_cols: Sequence[str], vector_col: str = "embedding",
    model=None, size: int = fixed.EMBEDDING_SIZE, store: DataFrame | None = None,
) -> DataFrame:
    """All rows, missing vectors computed, plus ``error`` for texts that failed.

    With a ``store`` every distinct text is embedded once and stored vectors are reused;
    ``key_col`` must then name each row.
    """
    text = tx.embedding_text(*[F.col(c) for c in text_cols])
    missing = df.filter(F.col(vector_col).isNull()).withColumn("_text", text).drop(vector_col)
    if store is None:
        others = [c for c in missing.columns if c not in (key_col, "_text")]
        filled = embed(
            missing, key_col=key_col, text_col="_text", model=model, size=size, keep=others
        ).withColumnRenamed("embedding", vector_col)
    else:
        fresh = new_store_rows(
            missing, store, text_col="_text", key_col=key_col, model=model, size=size
        )
        known = store.select("text_sha", "embedding", F.lit(None).cast("string").alias("error"))
        vectors = known.unionByName(fresh).select(
            "text_sha", F.col("embedding").alias(vector_col), "error"
        )
        # the join moves keys and hashes; texts are not needed after it
        is_blank = tx.is_blank(F.col("_text"))
        # blank texts meet nothing; their keys spread them
        own = F.concat(F.lit("\0"), F.col(key_col).cast("string"))
        filled = (
            missing.withColumn("text_sha", F.when(is_blank, own).otherwise(content_key(F.col("_text"))))
            .drop("_text")
            .join(vectors, "text_sha", "left")
            .withColumn("error", F.when(F.startswith("text_sha", F.lit("\0")), "blank text cannot be embedded").otherwise(F.col("error")))
        )
    present = df.filter(F.col(vector_col).isNotNull())
    return present.withColumn("error", F.lit(None).cast("string")).unionByName(
        filled.select(*df.columns, "error")
    )
