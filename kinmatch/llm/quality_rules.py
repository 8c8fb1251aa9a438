"""Quality rules: shape counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted on whole tables: one on the trusted
target (documents labelled good), one on the raw corpus (every document). A document's score
is the mean over its n-grams of log p_target - log p_raw, and a fixed threshold decides, so
the same document with the same model always gets the same verdict. It is taken for n-grams of
``order`` bytes and for single bytes, each with its own pair of multinomials and threshold.

How often a language is labelled says nothing of its documents. So raw counts are weighted to
the trusted mix: a language's documents weigh as many bytes as the trusted ones among them, and
within it each source by its own share, which a small source shares with its language. What is
left in the score is how n-grams differ within such a group. A language without trusted text
weighs nothing among n-grams, where nothing is known of it, but as much as the corpus among
single bytes: text in the letters of other languages stays, junk doesn't.

Defined cases: a null or empty text has no words, fails the base rules and scores 0; a text
shorter than one n-gram scores by its bytes; a null id is an ordinary value; repeated rows are judged one
by one; without labels or documents every score is 0 (nothing is known, nothing is rejected);
a document with contradicting labels isn't trusted; a null language or source is a group like
any other. Where a table has no language or source column, its rows are
not told apart by it. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import text as tx
from kinmatch.llm.shared import settled, small

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
SHAPE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "llr double, byte_llr double, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict.

    ``order`` bytes make an n-gram, hashed to ``2 ** bits`` buckets. A mean log ratio under
    ``threshold`` (nats per n-gram) rejects: ordinary text scores around +0.1, text whose
    n-grams the target lacks falls to -1 and far below. So does a mean over bytes under
    ``byte_threshold``: text with a few letters the target lacks scores -0.7 to 0, junk -2.
    """

    order: int = 3
    bits: int = 16
    threshold: float = -0.25
    byte_threshold: float = -1.0
    min_words: int = 20
    repeat_words: int = 8
    max_repeat_percent: int = 30
    source_bytes: int = 1 << 20
    trust_bytes: int = 4096

    @property
    def width(self) -> int:
        """Places of a model: buckets of n-grams, then bytes."""
        return (1 << self.bits) + 256


def ngrams(data: np.ndarray, bounds: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of bytes, and its row; n-grams don't cross texts."""
    count = len(data) - rules.order + 1
    if count <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    total = np.zeros(count, np.uint32)
    for j in range(rules.order):
        total *= np.uint32(0x01000193)
        total += data[j : j + count]
    total *= np.uint32(2654435761)
    total >>= np.uint32(32 - rules.bits)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    inside = row[:count] == row[rules.order - 1 :]
    return total[inside], row[:count][inside]


#: Weights are whole numbers of this part, so that sums don't depend on the order of rows.
UNIT = 1 << 30


def trusted_documents(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, group_cols: tuple) -> DataFrame:
    """``(text, lang, source, good)`` of every document; a column the table lacks is null."""
    good = (
        labels.groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_q"))
        .where("_q = 1")
        .select("_id", F.lit(True).alias("good"))
    )
    lang, source = (F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in group_cols)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), lang.alias("lang"), source.alias("source"))
    rows = rows.join(small(good, good.count()), "_id", "left")
    return rows.select("text", "lang", "source", F.coalesce("good", F.lit(False)).alias("good"))


def weighted(rows: DataFrame, rules: Rules) -> DataFrame:
    """Add ``weight`` and ``plain``, what a row's n-grams and bytes count in the raw corpus.

    Both in parts of ``UNIT``. For n-grams a language weighs by its share of trusted bytes, and a
    source by its own, as if ``source_bytes`` more with the language's share belonged to it. For
    bytes a language's share counts half at ``trust_bytes`` trusted bytes, the rest is the corpus's.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    cells = rows.groupBy("lang", "source").agg(
        F.sum(size).alias("bytes"), F.sum(F.when(F.col("good"), size).otherwise(0)).alias("trusted")
    )
    cells = settled(cells, "cells")
    everything = cells.agg(F.coalesce(F.sum("trusted") / F.greatest(F.sum("bytes"), F.lit(1)), F.lit(0.0))).first()[0]

    langs = cells.groupBy("lang").agg(F.sum("bytes").alias("_bytes"), F.sum("trusted").alias("_trusted"))
    own = F.col("_trusted") / F.greatest("_bytes", F.lit(1))
    known = F.col("_trusted") / (F.col("_trusted") + rules.trust_bytes)
    langs = langs.select(
        F.col("lang").alias("_lang"), "_bytes", F.round(own * UNIT).cast("long").alias("_of_lang"),
        F.round((known * own + (1 - known) * everything) * UNIT).cast("long").alias("plain"),
    )
    cells = cells.join(small(langs, langs.count()), F.col("lang").eqNullSafe(F.col("_lang")))
    prior = F.col("_of_lang") * F.lit(float(rules.source_bytes))
    share = F.round((F.col("trusted") * F.lit(float(UNIT)) + prior) / (F.col("bytes") + rules.source_bytes)).cast("long")
    cells = settled(cells.withColumn("_of_cell", share), "weights")
    # Sources are scaled together, so that a language's bytes weigh what they should in all.
    exact = F.sum(F.col("_of_cell").cast("decimal(19,0)") * F.col("bytes").cast("decimal(19,0)"))
    mass = cells.groupBy(F.col("lang").alias("_in")).agg(exact.cast("double").alias("_mass"))
    cells = cells.join(small(mass, mass.count()), F.col("lang").eqNullSafe(F.col("_in")))
    scale = F.when(F.col("_mass") > 0, F.col("_of_lang") * F.col("_bytes").cast("double") / F.col("_mass")).otherwise(1.0)
    weight = F.least(F.round(F.col("_of_cell") * scale), F.lit(float(UNIT))).cast("long")
    cells = cells.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), weight.alias("weight"), "plain")
    cells = settled(cells, "cell-weights")
    rows = rows.join(small(cells, cells.count()), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    return rows.select("text", "good", "weight", "plain")


def corpus_counts(
    documents: DataFrame, labels: DataFrame, rules: Rules, id_col="doc_id", text_col="text", label_col="quality", lang_col="lang", source_col="source"
) -> DataFrame:
    """``(bucket, raw, target)`` over every document; tasks add up before the shuffle.

    ``raw`` is weighted, in parts of ``UNIT``.
    """
    rows = trusted_documents(documents, labels, id_col, text_col, label_col, (lang_col, source_col))
    rows = weighted(rows, rules)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = rules.width
        raw, target = np.zeros((2, width), np.int64), np.zeros(width, np.int64)

        def add(bucket, weight, good):
            # Halves, so that sums of doubles stay exact.
            for k, half in enumerate((weight >> 15, weight & 0x7FFF)):
                raw[k] += np.bincount(bucket, half, width).astype(np.int64)
            target[:] += np.bincount(bucket[good], minlength=width)

        for batch in batches:
            for part in tx.chunks(batch, 0):
                data, bounds = tx.flat(part.column(0))
                good = part.column(1).to_numpy(zero_copy_only=False)
                weight, plain = part.column(2).to_numpy(), part.column(3).to_numpy()
                bucket, row = ngrams(data, bounds, rules)
                add(bucket, weight[row], good[row])
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    seen = np.bincount(data[a:b], minlength=256)
                    raw[0, -256:] += seen * (plain[i] >> 15)
                    raw[1, -256:] += seen * (plain[i] & 0x7FFF)
                    target[-256:] += seen * good[i]
        whole = (raw[0] << 15) + raw[1]
        some = np.flatnonzero(whole | target)
        yield pa.record_batch({"bucket": some.astype(np.int32), "raw": whole[some], "target": target[some]})

    return (
        rows.mapInArrow(lambda batches: tx.tidied(count(batches)), "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum(F.col("raw").cast("decimal(28,0)")).cast("double").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(documents: DataFrame, labels: DataFrame, rules: Rules = Rules(), **columns) -> np.ndarray:
    """The model: a log ratio for each bucket and then for each byte, add-one smoothed."""
    counts = corpus_counts(documents, labels, rules, **columns).toPandas()
    raw, target = np.zeros(rules.width), np.zeros(rules.width)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"] / UNIT, counts["target"]
    if not target.sum():
        return np.zeros(rules.width)

    def ratios(which: slice) -> np.ndarray:
        share = [np.log(x[which] + 1) - np.log(x[which].sum() + len(x[which])) for x in (target, raw)]
        return share[0] - share[1]

    return np.concatenate([ratios(slice(0, 1 << rules.bits)), ratios(slice(1 << rules.bits, None))])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs again, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    before[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def shape(data: np.ndarray, bounds: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(bounds) - 1
    begin, end, row = tx.words(data, bounds)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), bounds))

    no_start = tx.WHITE[data] | ((data & 0xC0) == 0x80)
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": np.diff(bounds) - per_row(no_start),
        "n_symbols": per_row(SYMBOLS[data]),
    }
    first, last, of = tx.lines(data, bounds)
    some = np.searchsorted(begin, first) < np.searchsorted(begin, last)
    first, last, of = first[some], last[some], of[some]
    keys = tx.mixed(tx.hashed(data, first, last) ^ tx.mixed(of.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(of[_repeats(keys)[1]], minlength=n)

    hashes = tx.hashed(data, begin, end)
    found, at = tx.windows(hashes, row, rules.repeat_words)
    again = at[_repeats(tx.mixed(found ^ tx.mixed(row[at].astype(np.uint64))))[0]]
    cover = np.zeros(len(begin) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + rules.repeat_words, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def verdict(text: Column, ratios: np.ndarray, rules: Rules = Rules()) -> Column:
    """A struct of counts, score and decision for a text column (``SHAPE``)."""
    table = ratios.astype(np.float64)

    @F.arrow_udf(f"struct<{SHAPE.replace(' long', ':long').replace(' double', ':double').replace(' boolean', ':boolean')}>")
    def judged(texts: pa.Array) -> pa.Array:
        parts = []
        batch = pa.record_batch([texts], ["text"])
        for part in tx.chunks(batch, 0):
            data, bounds = tx.flat(part.column(0))
            out = shape(data, bounds, rules)
            bucket, row = ngrams(data, bounds, rules)
            n = len(bounds) - 1
            total = np.bincount(row, table[bucket], minlength=n)
            out["llr"] = total / np.maximum(np.bincount(row, minlength=n), 1)
            sums = np.concatenate([[0.0], np.cumsum(table[-256:][data])])
            out["byte_llr"] = np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
            out["base_failed"] = (out["n_words"] < rules.min_words) | (
                100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"]
            )
            out["kept"] = ~out["base_failed"] & (out["llr"] >= rules.threshold) & (out["byte_llr"] >= rules.byte_threshold)
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out)))
        kind = pa.struct([(k, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for k, t in (x.split() for x in SHAPE.split(", "))])
        out = pa.concat_arrays(parts) if parts else pa.array([], kind)
        del parts
        tx.tidy()
        return out

    return judged(text)


def judged_documents(
    documents: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col="doc_id", text_col="text", lang_col="lang", source_col="source"
) -> DataFrame:
    """One row per document: id, counts, score and decision. The model is fitted first."""
    ratios = log_ratios(documents, labels, rules, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    rows = documents.select(F.col(id_col), verdict(F.col(text_col), ratios, rules).alias("_v"))
    return rows.select(id_col, "_v.*")
