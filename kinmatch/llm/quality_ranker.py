"""Quality scores from preference pairs (Bradley-Terry).

A document has a strength, linear in its features: square roots of hashed byte n-gram shares,
and a few shares of its shape. Pairs of a good and a bad labelled document are preferences;
the probability that the good one wins is the logistic function of the difference of their
strengths, and the weights minimise the logistic loss over all pairs drawn. A strength is
turned into a probability of label 1 on the same labelled rows, and the quantile of their
scores at the share of bad ones is the cut.

Every labelled row that may be learned from is learned from. They are dealt by hash into blocks
of about ``BLOCK`` rows, each fits weights to ``pairs`` pairs in which each of its rows stands,
and the weights are their mean over all blocks by rows; a label too rare for that is repeated in
several blocks. Calibration and cut are taken over the strengths of all these rows.

Defined cases: a null or empty text
has no n-grams and is scored by the rest; a null label isn't used, of contradicting labels the
smallest counts; with one label only, or none, every score is the share of label 1 (0.5 if
nothing is known); repeated rows get equal scores; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm import text as tx
from kinmatch.llm.quality_rules import Rules, ngrams, shape
from kinmatch.llm.shared import settled, small

RULES = Rules(order=3, bits=12)
SHAPES = 7
WIDTH = (1 << RULES.bits) + SHAPES
ROWS = 256
#: Rows of a block that is fitted at once, the most in one block, and the least of one label.
BLOCK, MOST, LEAST = 4096, 6144, 512
#: Bins of the strengths in which the cut is looked for.
BINS = 10_000
_upper = np.zeros(256, bool)
_upper[65:91] = True


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    slope: float
    offset: float
    cut: float


def features(texts: pa.Array) -> np.ndarray:
    data, bounds = tx.flat(texts)
    n, size = len(bounds) - 1, 1 << RULES.bits
    bucket, row = ngrams(data, bounds, RULES)
    counts = np.bincount(row.astype(np.int64) * size + bucket, minlength=n * size).reshape(n, size)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :size] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    s = shape(data, bounds, RULES)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    upper = np.diff(np.searchsorted(np.flatnonzero(_upper[data]), bounds))
    lines = np.bincount(tx.lines(data, bounds)[2], minlength=n)
    out[:, size:] = np.stack(
        [
            s["n_repeat_words"] / words,
            np.minimum(s["n_symbols"] / chars, 1),
            s["n_dup_lines"] / np.maximum(lines, 1),
            upper / chars,
            np.minimum(chars / words, 40) / 40,
            1 / words,
            np.ones(n),
        ],
        axis=1,
    )
    return out


def small_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for part in tx.chunks(batch, column):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def labelled_texts(documents: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(_label, draw, text)`` of every usable row whose id has a label."""
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    known = known.where("_label IS NOT NULL AND _id IS NOT NULL")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "_id"), 11) / F.lit(float(1 << 53))
    known = known.withColumn("draw", draw)
    rows = documents.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(small(known, known.count()), F.col("id") == F.col("_id")).select("_label", "draw", "text")


def labelled(documents: DataFrame, labels: DataFrame, usable: Column, per_label: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(label, draw, features)`` of about so many documents of each label, at most twice as many.

    For a look at the features: models are fitted on all rows. Documents are drawn by id; where
    one id stands on many rows, those beyond the bound are cut by the order of their draws.
    """
    rows = labelled_texts(documents, labels, usable, id_col, text_col, label_col)
    counts = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_of")).where("_of IS NOT NULL AND _id IS NOT NULL")
    counts = counts.groupBy("_of").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(counts), F.col("_label") == F.col("_of")).where(F.col("draw") * F.col("_n") < per_label)
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("draw", F.xxhash64("text")))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= 2 * per_label).select("_label", "draw", "text")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, 2):
                found = features(part.column(2)).astype(np.float16)
                yield pa.record_batch({"label": part.column(0).cast(pa.int32()), "draw": part.column(1), "features": pa.array([x.tobytes() for x in found], pa.binary())})

    return rows.mapInArrow(taken, "label int, draw double, features binary")


def scale() -> np.ndarray:
    return np.where(np.arange(WIDTH) < 1 << RULES.bits, 4.0, 1.0).astype(np.float32)


def preferred(x: np.ndarray, label: np.ndarray, pairs: int, steps: int, decay: float) -> np.ndarray:
    """Weights under which the good rows of a block win against bad ones."""
    dice = np.random.default_rng(0)
    good, bad = np.flatnonzero(label), np.flatnonzero(~label)
    wins, loses = dice.choice(good, pairs), dice.choice(bad, pairs)
    # a row that no pair holds gets one
    left, right = np.setdiff1d(good, wins), np.setdiff1d(bad, loses)
    wins, loses = np.concatenate([wins, left, dice.choice(good, len(right))]), np.concatenate([loses, dice.choice(bad, len(left)), right])
    w, speed = np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32)
    for _ in range(steps):
        ahead = w + 0.9 * speed
        strength = x @ ahead
        lost = 1 / (1 + np.exp(np.minimum(strength[wins] - strength[loses], 80)))
        push = np.bincount(wins, lost, len(x)) - np.bincount(loses, lost, len(x))
        speed = 0.9 * speed + 2.0 * ((push.astype(np.float32) / len(wins)) @ x - decay * ahead)
        w = w + speed
    return w


def block_means(rows: DataFrame, good: int, bad: int, pairs: int, steps: int, decay: float) -> np.ndarray:
    """The mean of the weights of all blocks, by their rows."""
    blocks = -(-(good + bad) // BLOCK)

    def copies(n: int) -> int:
        return min(blocks, max(1, -(-LEAST * blocks // n)))

    times = F.when(F.col("_label") == 1, copies(good)).otherwise(copies(bad))
    at = F.explode(F.sequence(F.lit(0), times - 1)).alias("_at")
    rows = rows.select((F.col("_label") == 1).alias("good"), "draw", "text", at)
    rows = rows.select(F.pmod(F.xxhash64("draw", "text") + F.col("_at"), F.lit(blocks)).alias("block"), "good", "draw", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, held = np.zeros(WIDTH), 0, []
        size, present = 0, None

        def close():
            nonlocal total, count, size
            if held:
                x = np.concatenate([h[2] for h in held])
                label, draw = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                if label.any() and not label.all():
                    order = sorted(range(len(x)), key=lambda i: (draw[i], x[i].tobytes()))
                    x = x[order].astype(np.float32)
                    x *= scale()
                    total += len(x) * preferred(x, label[order], pairs, steps, decay).astype(np.float64)
                    count += len(x)
            size = 0

        for batch in batches:
            for part in small_parts(batch, 3):
                block = part.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), part.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if block[a] != present or size + b - a > MOST:
                        close()
                    present = block[a]
                    piece = part.slice(a, b - a)
                    label = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                    held.append((label, piece.column(2).to_numpy(), features(piece.column(3)).astype(np.float16)))
                    size += b - a
        close()
        if count:
            yield pa.record_batch({"n": [count], "weights": pa.array([total.tobytes()], pa.binary())})

    sums = (
        rows.repartition("block")
        .sortWithinPartitions("block", "draw", F.xxhash64("text"))
        .mapInArrow(lambda batches: tx.tidied(fit(batches)), "n long, weights binary")
        .collect()  # a row for each task
    )
    count = sum(r["n"] for r in sums)
    total = np.sum([np.frombuffer(r["weights"]) for r in sums], axis=0) if sums else np.zeros(WIDTH)
    return (total / max(count, 1)).astype(np.float32)


def strengths(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(good, strength)`` of all labelled rows, stored."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, 1):
                x = features(part.column(1)).astype(np.float16).astype(np.float32) * scale()
                yield pa.record_batch({"good": part.column(0), "strength": (x @ weights).astype(np.float64)})

    rows = rows.select((F.col("_label") == 1).alias("good"), "text")
    return settled(rows.mapInArrow(lambda batches: tx.tidied(judge(batches)), "good boolean, strength double"), "strengths")


def calibrated(rows: DataFrame, good: int, bad: int) -> tuple[float, float]:
    """Slope and offset of the logistic curve from strengths to label 1.

    There may be far more rows of one label: the labels weigh alike.
    """
    middle, spread = rows.agg(F.avg("strength"), F.stddev_pop("strength")).first()
    spread, n = max(spread, 1e-6), good + bad
    target = F.when(F.col("good"), (good + 1) / (good + 2)).otherwise(1 / (bad + 2))
    worth = F.when(F.col("good"), 0.5 * n / good).otherwise(0.5 * n / bad)
    rows = rows.select(((F.col("strength") - middle) / spread).alias("z"), target.alias("target"), worth.alias("worth"))
    a, b = 1.0, 0.0
    for _ in range(50):
        odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("z") + b))
        at = rows.withColumn("p", 1 / (1 + F.exp(-odds)))
        off, h, z = F.col("worth") * (F.col("target") - F.col("p")), F.col("worth") * F.col("p") * (1 - F.col("p")) + 1e-9, F.col("z")
        gz, g, hzz, hz, hh = at.agg(*[F.sum(c) for c in (off * z, off, h * z * z, h * z, h)]).first()
        move = np.linalg.solve([[hzz + 1e-3, hz], [hz, hh + 1e-3]], [gz, g])
        a, b = np.array([a, b]) + move
        if np.abs(move).max() < 1e-12:
            break
    return float(a / spread), float(b - a * middle / spread)


def quantile(rows: DataFrame, n: int, share: float) -> float:
    """The strength at this share of all, between two rows as numpy has it."""
    low, high = rows.agg(F.min("strength"), F.max("strength")).first()
    if low == high:
        return low
    at = share * (n - 1)
    ranks = [int(np.floor(at)), int(np.ceil(at))]
    bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("strength") - low) / (high - low) * BINS).cast("int"))
    rows = rows.select("strength", bin_of.alias("bin"))
    counts = np.zeros(BINS, np.int64)
    for r in rows.groupBy("bin").count().collect():
        counts[r["bin"]] = r["count"]
    ends = np.cumsum(counts)
    bins = sorted({int(np.searchsorted(ends, r, "right")) for r in ranks})
    values = sorted(tuple(r) for r in rows.where(F.col("bin").isin(bins)).groupBy("strength").count().collect())
    first = [int(ends[b] - counts[b]) for b in bins]
    found = []
    for r in ranks:
        own = int(np.searchsorted(ends, r, "right"))
        place = r - first[bins.index(own)] + sum(int(counts[x]) for x in bins if x < own)
        passed = np.cumsum([c for _, c in values])
        found.append(values[int(np.searchsorted(passed, place, "right"))][0])
    return float(found[0] + (found[1] - found[0]) * (at - ranks[0]))


def fitted(documents: DataFrame, labels: DataFrame, usable: Column, pairs=40_000, steps=400, decay=2e-5, id_col="doc_id", text_col="text", label_col="quality") -> Ranker:
    rows = labelled_texts(documents, labels, usable, id_col, text_col, label_col)
    good, bad = (x or 0 for x in rows.agg(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") != 1)).first())
    if not good or not bad:
        share = float(good / (good + bad)) if good + bad else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ranker(np.zeros(WIDTH, np.float32), 0.0, float(np.log(share / (1 - share))), 0.0)
    w = block_means(rows, good, bad, pairs, steps, decay)
    found = strengths(rows, w)
    slope, offset = calibrated(found, good, bad)
    return Ranker(w * scale(), slope, offset, quantile(found, good + bad, bad / (good + bad)))


def scored(text: Column, model: Ranker) -> Column:
    """``struct<score, selected>``: probability of label 1, and strength at or over the cut."""

    @F.arrow_udf("struct<score:double,selected:boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for part in small_parts(pa.record_batch([texts], ["text"]), 0):
            out.append((features(part.column(0)) @ model.weights).astype(np.float64))
        strength = np.concatenate(out)
        score = 1 / (1 + np.exp(-np.clip(model.slope * strength + model.offset, -30, 30)))
        return pa.StructArray.from_arrays([pa.array(score), pa.array(strength >= model.cut)], ["score", "selected"])

    return judge(text)


def ranked(documents: DataFrame, labels: DataFrame, held_out: Column, id_col="doc_id", text_col="text", **fit) -> DataFrame:
    """One row per document: id, held_out, score, selected."""
    model = fitted(documents, labels, ~held_out, id_col=id_col, text_col=text_col, **fit)
    rows = documents.select(F.col(id_col), held_out.alias("held_out"), scored(F.col(text_col), model).alias("_s"))
    return rows.select(id_col, "held_out", "_s.score", "_s.selected")
