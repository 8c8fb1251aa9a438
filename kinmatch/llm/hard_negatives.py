"""Hard negatives of anchors: per positive, the best other rows scoring just below it.

A positive's window holds the rows of another label that score from ``low`` percent of its score
up to its score. The windows of an anchor overlap, but their upper limits cut the scores into
disjoint slots, so a row is put into one slot only. Tasks keep the best rows of each slot, the
same is done once more across tasks, and a window's answer is read off the slots from its own
one downwards, cut at its lower limit.

All rows meet all anchors by definition; it is done in blocks. A block of anchors of at most
``BLOCK_BYTES`` travels to the tasks, which score their rows against it by matrix products and
hand on a few rows per anchor and slot. The table is read twice a block and never shuffled.

Components count as ``floor(256 * x)``, and scores are exact while they fit a long; beyond, they
stay at its bounds (components beyond 2^1000 count as that). Defined cases: rows with a null
label or vector, or a null or non-finite component, take no part; vectors of unequal lengths are
compared as if the shorter went on with zeros, so an empty one scores 0; a null id is no anchor
and comes after all others in ties. A row that is there twice takes two places, and an anchor
that is there twice has its answers twice; rows with the anchor's own id are never its
positives. A positive with a negative score has an empty window. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.shared import settled

#: Bytes of anchor vectors that travel at once.
BLOCK_BYTES = 16 << 20
#: Anchors and rows whose scores are held at once; the first tiles are small, to get a bound soon.
TILE_ANCHORS = 256
TILE_ROWS = [64, 256, 1024, 2048]
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
LARGEST = 2.0**1000


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids (null: the largest long), labels and whole-number vectors of the rows that take part, by length."""
    columns = [batch.column(n) for n in ("id", "label", "vector")]
    ids, labels = (c.fill_null(MOST).to_numpy(zero_copy_only=False) for c in columns[:2])
    column = columns[2]
    ends = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    starts, stops = ends[:-1], ends[1:]
    fit = (bad[stops] == bad[starts]) & ~columns[1].is_null().to_numpy(zero_copy_only=False)
    fit &= ~column.is_null().to_numpy(zero_copy_only=False)
    lengths = stops - starts
    for length in np.unique(lengths[fit]):
        rows = np.flatnonzero(fit & (lengths == length))
        found = values[starts[rows][:, None] + np.arange(length)]
        yield ids[rows], labels[rows], np.floor(256 * np.clip(found, -LARGEST, LARGEST))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as longs."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, LEAST + 1, MOST).astype(np.int64)


class Best:
    """The k best (score, id) of each key, ties by the smaller id."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.floor = np.full(keys, LEAST)
        self.floor_id = np.full(keys, MOST)
        self.kept = [np.empty(0, np.int64)] * 3

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor[key]
        better = (score > floor) | ((score == floor) & (ids < self.floor_id[key]))
        if not better.any():
            return
        key, score, ids = (np.concatenate([old, new[better]]) for old, new in zip(self.kept, (key, score, ids)))
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = rank == self.k - 1
        self.floor[key[last]], self.floor_id[key[last]] = score[last], ids[last]
        self.kept = [x[rank < self.k] for x in (key, score, ids)]


def tiles(n: int) -> Iterator[slice]:
    at = 0
    for size in TILE_ROWS + [TILE_ROWS[-1]] * (n // TILE_ROWS[-1] + 1):
        if at < n:
            yield slice(at, at + size)
        at += size


def kept_rows(rows: DataFrame, block, slots: int, k: int, choose) -> DataFrame:
    """``(anchor, slot, score, id)``: the k best rows of each anchor and slot within each task.

    ``choose(anchors, scores, ids, labels)`` gives the anchor, row and slot of candidates.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors, limits = block.value
        parts = range(0, len(anchors), TILE_ANCHORS)
        best = [Best(TILE_ANCHORS * slots, k) for _ in parts]
        for batch in batches:
            for ids, labels, found in vectors(batch):
                for kept, at in zip(best, parts):
                    here = slice(at, at + TILE_ANCHORS)
                    mine = (anchor_ids[here], anchor_labels[here], limits[here])
                    for part in tiles(len(ids)):
                        scores = products(anchors[here], found[part])
                        a, r, slot = choose(mine, scores, ids[part], labels[part])
                        kept.add(a * slots + slot, scores[a, r], ids[part][r])
        for kept, at in zip(best, parts):
            key, score, ids = kept.kept
            yield pa.record_batch({
                "anchor": pa.array(at + key // slots), "slot": pa.array((key % slots).astype(np.int32)),
                "score": pa.array(score), "id": pa.array(ids, mask=ids == MOST),
            })

    found = rows.mapInArrow(search, "anchor long, slot int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def same_label(mine, scores, ids, labels):
    """Other rows of the anchor's label; there is one slot."""
    a, r = np.nonzero((mine[1][:, None] == labels) & (mine[0][:, None] != ids))
    return a, r, 0


def in_slots(low: int):
    def choose(mine, scores, ids, labels):
        """Rows of another label that lie in a window, each with the one slot it belongs to."""
        limits = mine[2]
        a, r = np.nonzero((mine[1][:, None] != labels) & (scores <= limits[:, :1]) & (scores >= 0))
        score = scores[a, r]
        slot = (score[:, None] <= limits[a]).sum(axis=1) - 1
        upper = limits[a, slot]
        lies = score >= lowest(upper, low)
        return a[lies], r[lies], slot[lies]

    return choose


def lowest(upper: np.ndarray, low: int) -> np.ndarray:
    """The smallest whole score that is at least ``low`` percent of a score that isn't negative."""
    whole, rest = upper // 100, upper % 100
    return whole * low + -(-rest * low // 100)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col="vec_id", vector_col="embedding", label_col="label",
    positives: int = 5, negatives: int = 5, low: int = 80,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` says which rows are anchors; ids and labels are whole numbers. Results of each
    block of anchors are stored before the next one starts.
    """
    if not 0 <= low <= 100:
        raise ValueError("low is a percentage")
    spark = rows.sparkSession
    table = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("chosen"),
    ).where("label IS NOT NULL AND vector IS NOT NULL")
    asked = table.where("chosen AND id IS NOT NULL")
    count, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    bytes_each = 8 * max(width or 0, 2 * positives)
    parts = -(-2 * count * bytes_each // BLOCK_BYTES) if count * bytes_each > BLOCK_BYTES else 1
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(parts))
    results = [
        answered(spark, table, asked.where(number == part), positives, negatives, low) for part in range(parts)
    ]
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def answered(spark, table: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """The answers of one block of anchors, as a stored table."""
    groups = [g for b in asked.drop("chosen").toArrow().to_batches() for g in vectors(b)]
    width = max((v.shape[1] for *_, v in groups), default=0)
    ids, labels = (np.concatenate([np.empty(0, np.int64), *(g[i] for g in groups)]) for i in (0, 1))
    anchors = np.concatenate([np.zeros((0, width)), *(np.pad(v, ((0, 0), (0, width - v.shape[1]))) for *_, v in groups)])
    none = np.empty((len(ids), 0), np.int64)
    rows = table.drop("chosen")

    block = spark.sparkContext.broadcast((ids, labels, anchors, none))
    near = settled(kept_rows(rows, block, 1, positives, same_label), "hard-positives")
    block.destroy()
    # Distinct scores of an anchor's positives, from the highest, are the upper limits of its slots.
    limits = np.full((len(ids), positives), LEAST)
    places = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("upper"))
    for spot, upper in places.collect():
        limits[spot, : len(upper)] = upper

    block = spark.sparkContext.broadcast((ids, labels, anchors, limits))
    # Nothing lies above the highest limit, so slots are numbered from it downwards.
    best = kept_rows(rows, block, positives, negatives, in_slots(low))
    listed = best.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("rows"))
    slots = listed.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("slots"))
    names = spark.createDataFrame(
        [(i, int(x), [int(u) for u in limits[i]]) for i, x in enumerate(ids)], "anchor long, anchor_id long, uppers array<long>"
    )
    empty = F.lit(None).cast("array<struct<rank:int,score:long,id:long>>")
    down = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.coalesce(F.try_element_at("slots", j), F.coalesce(empty, F.array())))
    place = F.array_position("uppers", F.col("score"))
    windows = (
        near.where("score >= 0").select("anchor", F.col("id").alias("positive_id"), "score")
        .join(names, "anchor").join(slots, "anchor")
        # The slots from the positive's own one downwards, best first, cut at the lower limit.
        .withColumn("below", F.slice(F.flatten(F.slice(down, place.cast("int"), positives)), 1, negatives))
        .withColumn("least", F.expr(f"score div 100 * {low} + cast(ceil(score % 100 * {low} / 100) AS long)"))
        .withColumn("below", F.filter("below", lambda n: n["score"] >= F.col("least")))
    )
    found = windows.select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode("below").alias("at", "n"))
    result = settled(
        found.select(
            "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
            "positive_score", F.col("n.score").alias("negative_score"),
        ),
        "hard-negatives",
    )
    block.destroy()
    return result
