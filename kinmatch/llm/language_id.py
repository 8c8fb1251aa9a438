"""Language identification with string kernels.

Two texts are as similar as the share of n-grams (of one, two and three bytes, of letters in
lower case) that are present in both: the blended spectrum kernel on presence, normalised. A
few training texts per language are landmarks; their kernel matrix gives Nystrom features, and
kernel ridge regression of each language against the rest gives one weight per landmark and
language. Scoring a batch is two matrix products: presence rows by landmarks, by weights.

The model is fitted on a bounded sample: about ``per_language`` texts of each language, drawn
by a hash of the id over the whole table. Presence is hashed to ``BUCKETS`` buckets for each
length; collisions blur the kernel a little and change nothing else.

Defined cases: a text that is null or has no letters is ``und`` with score 0; ties go to the
language that sorts first; without any training text everything is ``und``; a null language
isn't learned; repeated rows get equal answers; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm import text as tx
from kinmatch.llm.shared import small

LENGTHS = (1, 2, 3)
BUCKETS = 1 << 13
WIDTH = BUCKETS * len(LENGTHS)
ROWS = 128
_plain = np.full(256, 0x20, np.uint8)
_plain[97:123] = np.arange(97, 123)
_plain[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # WIDTH x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages


def pieces(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, part.num_rows, ROWS):
        yield part.slice(at, ROWS)


def presence(texts: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    data, bounds = tx.flat(pc.utf8_lower(pc.fill_null(texts, "")))
    data = _plain[data].astype(np.uint32)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    out = np.zeros((len(bounds) - 1, WIDTH), np.float32)
    cells = out.reshape(-1)
    total = np.zeros(len(data), np.uint32)
    for k, n in enumerate(LENGTHS):
        count = len(data) - n + 1
        if count <= 0:
            break
        total = total[:count] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        bucket = (total * np.uint32(2654435761)) >> np.uint32(19)
        inside = row[:count] == row[n - 1 :]
        cells[(row[:count][inside].astype(np.int64) * WIDTH + k * BUCKETS) + bucket[inside]] = 1
    return out


def has_letters(texts: pa.Array) -> np.ndarray:
    plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(~plain):
        plain[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
    return plain


def training_rows(documents: DataFrame, usable: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, draw, bits)`` of about so many texts of each language, at most twice as many.

    Texts are drawn by id; where one id stands on many rows, those beyond the bound are cut by
    the order of their draws.
    """
    rows = documents.where(usable).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), id_col), 11) / F.lit(float(1 << 53))
    rows = rows.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    rows = rows.join(small(counts, counts.count()), F.col("lang") == F.col("_lang")).where(F.col("draw") * F.col("_n") < per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= 2 * per_language)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, 2):
                for few in pieces(part, 2):
                    bits = np.packbits(presence(few.column(2)).astype(bool), axis=1)
                    yield pa.record_batch({"lang": few.column(0), "draw": few.column(1), "bits": pa.array([x.tobytes() for x in bits], pa.binary())})

    return rows.select("lang", "draw", "text").mapInArrow(packed, "lang string, draw double, bits binary")


def fitted(documents: DataFrame, usable: Column, per_language=800, landmarks=256, ridge=1e-3, id_col="doc_id", text_col="text", lang_col="lang") -> Model | None:
    """Learn from the usable rows; none if there are none."""
    rows = training_rows(documents, usable, per_language, id_col, text_col, lang_col).toPandas()
    rows = rows.sort_values(["lang", "draw", "bits"], ignore_index=True)
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(rows["lang"] == x)[:each] for x in languages])

    def unpacked(which) -> np.ndarray:
        bits = np.frombuffer(b"".join(rows["bits"].iloc[which]), np.uint8).reshape(len(which), -1)
        out = np.unpackbits(bits, axis=1).astype(np.float32)
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    base = unpacked(chosen)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([unpacked(np.arange(a, min(a + 512, len(rows)))) @ base.T for a in range(0, len(rows), 512)])
    features = kernel.astype(np.float64) @ root
    wanted = np.where(rows["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    # Rows count by the inverse of their language's share, so that rare ones weigh as much.
    worth = 1 / np.array([np.sum(rows["lang"] == x) for x in languages])[np.argmax(wanted, axis=1)]
    worth = (worth / worth.mean())[:, None]
    solved = np.linalg.solve(features.T @ (features * worth) + ridge * len(rows) * np.eye(features.shape[1]), features.T @ (wanted * worth))
    return Model(languages, np.ascontiguousarray(base.T), (root @ solved).astype(np.float32))


def predicted(text: Column, model: Model | None) -> Column:
    """``struct<lang_pred, score>`` of a text column."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def language(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in tx.chunks(pa.record_batch([texts], ["text"]), 0):
            for few in pieces(part, 0):
                letters = has_letters(few.column(0))
                if model is None:
                    names += ["und"] * few.num_rows
                    scores.append(np.zeros(few.num_rows))
                    continue
                seen = presence(few.column(0))
                kernel = seen @ model.landmarks / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
                values = kernel @ model.weights
                best = values.argmax(axis=1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(best, letters)]
                score = np.clip((values[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)
                scores.append(np.where(letters, score, 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))], ["lang_pred", "score"])

    return language(text)


def identified(documents: DataFrame, held_out: Column, id_col="doc_id", text_col="text", lang_col="lang", **fit) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = fitted(documents, ~held_out, id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    rows = documents.select(F.col(id_col), held_out.alias("held_out"), predicted(F.col(text_col), model).alias("_p"))
    return rows.select(id_col, "held_out", "_p.lang_pred", "_p.score")
