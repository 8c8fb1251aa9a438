"""Similarity join of documents on word n-grams, by count vectors in an R-tree.

A document's set holds its distinct 5-word shingles. Two documents link when the Jaccard
similarity of their sets is at least 0.8; linked documents form components.

1. Shingles are hashed into ``GROUPS`` groups; the numbers per group are the document's point.
   The overlap of two sets is at most the sum of the smaller counts of each group.
2. Equal sets form a class, named by its smallest id; from here on a class is one point.
3. Classes that can link share a shingle among the first fifth of each set, in any one order of
   all shingles. The order puts shingles first whose hash bucket is light in the whole corpus,
   so that passages many documents share stand last. Shingles and their classes make blocks,
   parted where sizes leave a gap that no link spans; equal blocks are kept once, and blocks
   beyond ``TILE`` classes are cut into pairs of tiles.
4. In each block the points are packed into an R-tree, which is joined with itself: a pair of
   nodes goes on while the summed minima of their upper bounds can reach the overlap needed.
5. Surviving pairs are verified on whole sets. First only the best partner of each class is
   taken from each block; pairs within a component so found need no check any more. Then every
   surviving pair across components is verified, so no link between components is missed.

Defined cases: null or empty texts and texts of white space have an empty set and link with
nothing; with fewer than five words the whole sequence is the one shingle; rows with a null id
get a null component and link with nothing; repeated rows are in one class; an id that stands
on different texts stands for each of them. Only id and text are read. Hashes have 64 bits (a
class is told by 128), so results are exact up to hash collisions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinmatch.llm import text as tx
from kinmatch.llm.shared import components, fresh, settled, small

WORDS = 5
#: Dimensions of the points of sets up to COARSE shingles, and of larger ones, whose counts say
#: too little in few groups. Sets that can link with either kind have both points. Coarse counts
#: take a byte: with at most 1500 hashes in 256 groups none reaches 256 (as unlikely as a clash).
GROUPS, FINE_GROUPS = 256, 2048
COARSE = 1200
#: Buckets of the corpus sketch that orders shingles, one byte each once it is broadcast.
SKETCH_BITS = 22
#: Steps of the order for each doubling of a bucket's weight; ``MEAN_STEP`` is the mean bucket.
STEPS, MEAN_STEP = 16, 64
#: Classes of a block that meet in one task; larger blocks become pairs of tiles.
TILE = 4096
LEAF = 16


def shingles(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and their rows in order."""
    data, bounds = tx.flat(part.column(column))
    data = tx.LOWER[data]
    begin, end, row = tx.words(data, bounds)
    hashes = tx.hashed(data, begin, end)
    found, at = tx.windows(hashes, row, WORDS)
    counts = np.bincount(row, minlength=part.num_rows)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if not len(short):
        return found, row[at]
    extra = np.empty(len(short), np.uint64)
    first = np.searchsorted(row, short)
    for n in range(1, WORDS):
        own = np.flatnonzero(counts[short] == n)
        total = np.full(len(own), n, np.uint64)
        for j in range(n):
            total *= np.uint64(0xA0761D6478BD642F)
            total += hashes[first[own] + j]
        extra[own] = tx.mixed(total)
    rows = np.concatenate([row[at], short])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([found, extra])[order], rows[order]


def sketch(documents: DataFrame, text_col: str) -> np.ndarray:
    """How heavy each bucket of shingle hashes is in the whole corpus, in steps of its logarithm."""
    size, slots = 1 << SKETCH_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for part in tx.chunks(batch, 0):
                found, _ = shingles(part, 0)
                np.add.at(total, (found & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            pieces = [zlib.compress(x.tobytes(), 1) for x in np.split(total, slots)]
            yield pa.record_batch({"slot": np.arange(slots, dtype=np.int32), "counts": pa.array(pieces, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(zlib.decompress(piece.as_py()), np.uint32).astype(np.int64)
                sums[slot] = sums[slot] + values if slot in sums else values
        if sums:
            yield pa.record_batch({"slot": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})

    kind = "slot int, counts binary"
    sums = documents.select(text_col).mapInArrow(lambda batches: tx.tidied(count(batches)), kind).repartition("slot").mapInArrow(lambda batches: tx.tidied(add(batches)), kind)
    pieces = {row[0]: row[1] for row in sums.collect()}  # one packed byte string for each of 64 slots

    def counts(slot: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(pieces[slot]), np.int64)

    mean = max(1.0, sum(int(counts(slot).sum()) for slot in pieces) / size)
    order = np.zeros(size, np.uint8)
    for slot in pieces:  # unpacked one at a time, as the driver is small
        steps = STEPS * np.log2(np.maximum(counts(slot) / mean, 1e-9)) + MEAN_STEP
        order[slot * (size // slots) : (slot + 1) * (size // slots)] = np.clip(steps, 0, 255).astype(np.uint8)
    return order


def profiles(documents: DataFrame, order: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, s1, s2, point, fine, prefix)``: set size, class, counts per group, first shingles."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    signed = np.int64

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, 1):
                found, row = shingles(part, 1)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                n = np.zeros(part.num_rows, signed)
                s1, s2 = n.copy(), n.copy()
                points, fine, prefixes = [], [], []
                for i in range(part.num_rows):
                    own = np.unique(found[bounds[i] : bounds[i + 1]])
                    n[i] = k = len(own)
                    s1[i] = own.sum().astype(signed)
                    s2[i] = tx.mixed(own).sum().astype(signed)
                    counts = np.bincount((own >> np.uint64(53)).astype(np.int64), minlength=FINE_GROUPS)
                    coarse = counts.reshape(GROUPS, -1).sum(axis=1)
                    points.append(np.minimum(coarse, 255).astype(np.uint8).tobytes() if 4 * k <= 5 * COARSE else b"")
                    fine.append(counts.astype(np.uint16).tobytes() if k > COARSE else b"")
                    first = k - (4 * k + 4) // 5 + 1 if k else 0
                    weight = order[own & mask].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8)
                    if first < k:
                        early = np.argpartition(weight, first - 1)[:first]
                        own = own[early[np.argsort(weight[early])]]
                    else:
                        own = own[np.argsort(weight)]
                    prefixes.append(own.astype(signed))
                lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "n": n,
                        "s1": s1,
                        "s2": s2,
                        "point": pa.array(points, pa.binary()),
                        "fine": pa.array(fine, pa.binary()),
                        "prefix": pa.ListArray.from_arrays(lengths, np.concatenate(prefixes)),
                    }
                )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(
        lambda batches: tx.tidied(profile(batches)), f"id {kind}, n long, s1 long, s2 long, point binary, fine binary, prefix array<long>"
    )


def set_rows(documents: DataFrame) -> DataFrame:
    """``(id, s1, shingles)`` with the sorted shingles of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, 1):
                found, row = shingles(part, 1)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = [np.unique(found[a:b]) for a, b in zip(bounds, bounds[1:])]
                lengths = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "s1": np.array([x.sum() for x in own], np.uint64).astype(np.int64),
                        "shingles": pa.ListArray.from_arrays(lengths, np.concatenate(own).astype(np.int64)),
                    }
                )

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(lambda batches: tx.tidied(sets(batches)), f"id {kind}, s1 long, shingles array<long>")


def blocks(classes: DataFrame) -> DataFrame:
    """``(block, side, id, s1, n, lead)``: classes that share an early shingle.

    ``side`` is 0 in a block that is joined with itself, else 1 or 2 for its two tiles. Rows
    come sorted by hash and size, so a task holds one tile's worth of a hash's classes at a
    time and the tiles before it that are within a factor of 0.8 in size.
    """
    rows = classes.select(
        F.posexplode("prefix").alias("place", "hash"), "id", "s1", "n"
    ).withColumn("lead", F.expr("place < n - (8 * n + 8) div 9 + 1"))
    rows = rows.select("hash", "n", "id", "s1", "lead")
    kind = classes.schema["id"].dataType.simpleString()

    def emit(tile, other=None):
        """Rows of one block; its name is drawn from its members, so equal blocks agree.

        They come together with their members' leads joined, which gives the same pairs.
        """
        sides = [(0, tile)] if other is None else [(1, other), (2, tile)]
        name = np.uint64(len(sides))
        for side, (n, ids, s1, lead) in sides:
            own = tx.mixed(s1.astype(np.uint64) ^ tx.mixed(n.astype(np.uint64)))
            name = tx.mixed(np.array([name ^ own.sum() ^ np.uint64(side)], np.uint64))[0]
        block = np.array([name], np.uint64).astype(np.int64)[0]
        return [(np.full(len(t[0]), block), np.full(len(t[0]), side, np.int8), t[1], t[2], t[0], t[3]) for side, t in sides]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list = []
        tiles: list = []  # earlier tiles of the present hash, each as (n, ids, s1, lead)
        rest: pa.Table | None = None

        def flush():
            cols = [np.concatenate([x[k] for x in out]) if k != 2 else pa.concat_arrays([x[2] for x in out]) for k in range(6)]
            out.clear()
            return pa.record_batch(cols, ["block", "side", "id", "s1", "n", "lead"])

        def add(rows):
            leads = tx.mixed(np.concatenate([r[3].astype(np.uint64) * r[5] for r in rows])).sum()
            if (name := int(rows[0][0][0]) ^ int(leads)) not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                out.extend(rows)

        def close(t, more: bool):
            """One tile of a hash; more: further tiles of the same hash can follow."""
            tile = (t.column(1).to_numpy(), t.column(2).combine_chunks(), t.column(3).to_numpy(), t.column(4).to_numpy(zero_copy_only=False))
            tiles[:] = [x for x in tiles if 10 * x[0][-1] >= 8 * tile[0][0]]
            if len(tile[0]) > 1 and tile[3].any():
                add(emit(tile))
            for x in tiles:
                add(emit(tile, x))
            if more:
                tiles.append(tile)

        def drain(t: pa.Table, last: bool):
            """Close every whole hash in t; what may go on is given back.

            Where the next larger set is too large for all before it, a hash begins anew.
            """
            hashes, n = t.column(0).to_numpy(), t.column(1).to_numpy()
            cuts = np.flatnonzero((hashes[1:] != hashes[:-1]) | (10 * n[:-1] < 8 * n[1:])) + 1
            starts = np.concatenate([[0], cuts])
            stops = np.concatenate([cuts, [len(hashes)]])
            many = np.flatnonzero((stops - starts > 1) | (np.arange(len(starts)) == 0))
            for i in many:
                a, b = int(starts[i]), int(stops[i])
                if i:
                    tiles.clear()
                if i == len(starts) - 1 and not last:
                    break
                while b - a > TILE:
                    close(t.slice(a, TILE), True)
                    a += TILE
                if b - a > 1 or tiles:
                    close(t.slice(a, b - a), False)
            if last:
                return None
            a, b = int(starts[-1]), int(stops[-1])
            if len(starts) > 1:
                tiles.clear()
            while b - a > TILE:
                close(t.slice(a, TILE), True)
                a += TILE
            return t.slice(a, b - a)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = drain(pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t, False)
            while sum(len(x[0]) for x in out) > 50_000:
                yield flush()
        if rest is not None and rest.num_rows:
            drain(rest, True)
        if out:
            yield flush()

    return (
        rows.repartition("hash")
        .sortWithinPartitions("hash", "n", "id", "s1")
        .mapInArrow(lambda batches: tx.tidied(cut(batches)), f"block long, side byte, id {kind}, s1 long, n long, lead boolean")
        .groupBy("block", "side", "id", "s1", "n")
        .agg(F.max("lead").alias("lead"))
    )


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap that sets of these sizes must have for a similarity of 0.8."""
    return -((-4 * (a + b)) // 9)


class Tree:
    """An R-tree over points, packed bottom-up in order of size; levels[0] holds the points."""

    def __init__(self, points: np.ndarray, n: np.ndarray, label: np.ndarray):
        self.levels = [(points, n, n, label, label)]
        while len(self.levels[-1][1]) > 1:
            high, small_n, large_n, least, most = self.levels[-1]
            at = np.arange(0, len(small_n), LEAF)
            self.levels.append(
                (
                    np.maximum.reduceat(high, at),
                    np.minimum.reduceat(small_n, at),
                    np.maximum.reduceat(large_n, at),
                    np.minimum.reduceat(least, at),
                    np.maximum.reduceat(most, at),
                )
            )


def packed(points: np.ndarray, n: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Packing order: bands of size, and by the fullest group within a band (ties by class)."""
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(1.1)).astype(np.int64)
    return np.lexsort((s1, points.argmax(axis=1), band))


def tree_pairs(a: Tree, b: Tree, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of point indices that pass the bound, with their bound; in bounded pieces."""
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > max(256, (1 << 22) // a.levels[0][0].shape[1]):
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        left, right = (t.levels[min(level, len(t.levels) - 1)] for t in (a, b))
        sizes = 10 * np.minimum(left[2][i], right[2][j]) >= 8 * np.maximum(left[1][i], right[1][j])
        apart = ~((left[3][i] == right[3][j]) & (left[4][i] == left[3][i]) & (right[4][j] == right[3][j]))
        go = sizes & apart
        i, j = i[go], j[go]
        bound = np.minimum(left[0][i], right[0][j]).sum(axis=1, dtype=np.int64)
        go = bound >= needed(left[1][i], right[1][j])
        i, j, bound = i[go], j[go], bound[go]
        if not len(i):
            continue
        if level == 0:
            if itself:
                go = i < j
                i, j, bound = i[go], j[go], bound[go]
            yield i, j, bound
            continue
        i, j = below(a, level, i, j, LEAF, 0)
        j, i = below(b, level, j, i, LEAF, 0)
        if itself:
            go = i <= j
            i, j = i[go], j[go]
        stack.append((level - 1, i, j))


def below(tree: Tree, level: int, own: np.ndarray, other: np.ndarray, fan: int, _: int):
    """Replace each node by its children; a tree that is not so high keeps its root."""
    if level >= len(tree.levels):
        return own, other
    children = (own[:, None] * fan + np.arange(fan)).ravel()
    go = children < len(tree.levels[level - 1][1])
    return children[go], np.repeat(other, fan)[go]


def candidates(members: DataFrame, first: bool) -> DataFrame:
    """Pairs of classes that a block's tree can't rule out.

    ``members`` has the rows of ``blocks`` with ``point`` and ``label``. With ``first``, only
    the best partner of each class in a block; else all pairs whose labels differ.
    """
    id_kind = members.schema["id"].dataType.simpleString()
    seen: set[int] = set()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        seen.clear()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            block = t.column("block").to_numpy()
            cut = int(np.searchsorted(block == block[-1], True)) if len(block) else 0
            yield from pairs_of(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from pairs_of(rest)

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        block, side, n = (t.column(k).to_numpy() for k in ("block", "side", "n"))
        ids, s1 = t.column("id").combine_chunks(), t.column("s1").to_numpy()
        label, lead = t.column("label").to_numpy(), t.column("lead").to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        out_i, out_j = [], []
        for column, own in (("point", 4 * n <= 5 * COARSE), ("fine", n > COARSE)):
            rows = np.flatnonzero(own)
            if len(rows) < 2:
                continue
            kept = t.column(column).take(pa.array(rows)).combine_chunks()
            kind = np.uint8 if column == "point" else np.uint16
            points = np.frombuffer(b"".join(kept.to_pylist()), kind).reshape(len(rows), -1)
            # Pairs of two large sets are left to the fine points.
            most = COARSE if column == "point" else np.inf
            cuts = np.searchsorted(rows, starts)
            two = cuts[:-1][np.diff(cuts) == 2]
            if len(two):  # blocks of two, the most by far, are compared at once
                for at in range(0, len(two), 4096):
                    p = two[at : at + 4096]
                    i, j = rows[p], rows[p + 1]
                    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                    bound = np.minimum(points[p], points[p + 1]).sum(axis=1, dtype=np.int64)
                    go = (10 * low >= 8 * high) & (bound >= needed(low, high)) & (label[i] != label[j]) & (low <= most)
                    out_i.append(i[go])
                    out_j.append(j[go])
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 3:
                    continue
                here = np.arange(a, b)
                sides = [here] if side[rows[a]] == 0 else [here[side[rows[a:b]] == k] for k in (1, 2)]
                if any(not len(x) for x in sides):
                    continue
                sides = [x[packed(points[x], n[rows[x]], s1[rows[x]])] for x in sides]
                trees = [Tree(points[x], n[rows[x]], label[rows[x]]) for x in sides]
                best = {}
                for i, j, bound in tree_pairs(trees[0], trees[-1], len(sides) == 1):
                    i, j = rows[sides[0][i]], rows[sides[-1][j]]
                    smaller = np.where((n[i] < n[j]) | ((n[i] == n[j]) & (s1[i] < s1[j])), i, j)
                    go = lead[smaller] & (10 * n[i] >= 8 * n[j]) & (10 * n[j] >= 8 * n[i]) & (np.minimum(n[i], n[j]) <= most)
                    i, j, bound = i[go], j[go], bound[go]
                    if not first:
                        yield from pairs(t, ids, s1, i, j)
                        continue
                    score = bound / (n[i] + n[j] - bound)
                    for k in np.lexsort((i, -score, j)):
                        own = int(j[k])
                        if own not in best or (score[k], -i[k]) > best[own][:2]:
                            best[own] = (score[k], -i[k], int(i[k]))
                if best:
                    out_i.append(np.array([x[2] for x in best.values()]))
                    out_j.append(np.array(list(best)))
        if out_i:
            yield from pairs(t, ids, s1, np.concatenate(out_i), np.concatenate(out_j))

    def pairs(t, ids, s1, i, j) -> Iterator[pa.RecordBatch]:
        """Pairs that the task hasn't given out yet, told by a hash of both classes."""
        swap = s1[i] > s1[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        names = tx.mixed(s1[i].astype(np.uint64) ^ tx.mixed(s1[j].astype(np.uint64) + np.uint64(1)))
        _, at = np.unique(names, return_index=True)
        at = at[np.fromiter((x not in seen for x in names[at].tolist()), bool, len(at))]
        if len(at):
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(names[at].tolist())
            i, j = i[at], j[at]
            yield pa.record_batch([ids.take(pa.array(i)), pa.array(s1[i]), ids.take(pa.array(j)), pa.array(s1[j])], ["a", "a1", "b", "b1"])

    return (
        members.repartition("block")
        .sortWithinPartitions("block", "side", "n", "s1")
        .mapInArrow(lambda batches: tx.tidied(join(batches)), f"a {id_kind}, a1 long, b {id_kind}, b1 long")
        .distinct()
    )


def pair_sets(documents: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, s1, shingles)`` of the classes that stand in a pair, from their whole texts."""
    nodes = pairs.select("a", "a1").union(pairs.select("b", "b1")).toDF("id", "s1").distinct()
    nodes = settled(nodes, "nodes")
    count = nodes.count()
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(small(nodes.select("id").distinct(), count), "id", "left_semi")
    return settled(set_rows(texts).join(small(nodes, count), ["id", "s1"], "left_semi"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 0.8."""
    one, two = (sets.select(F.col("id").alias(k), F.col("s1").alias(f"{k}1"), F.col("shingles").alias(f"s_{k}")) for k in "ab")
    rows = pairs.join(one, ["a", "a1"]).join(two, ["b", "b1"])
    rows = rows.withColumn("both", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    return rows.where(100 * F.col("both") >= 80 * (F.size("s_a") + F.size("s_b") - F.col("both"))).select("a", "a1", "b", "b1").distinct()


def node(name: str):
    return F.struct(F.col(name).alias("id"), F.col(f"{name}1").alias("s1"))


def row_components(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, s1, s2, component, first)`` for every row.

    ``first`` rows have the smallest id of their component, and its class where that id stands
    on several texts; so have all rows that link with nothing.
    """
    rows = profiles(documents, sketch(documents, text_col), id_col, text_col)
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "profiles")
    named = rows.where("n > 0 AND id IS NOT NULL")
    heads = named.groupBy("s1", "s2").agg(F.min(F.struct("id", "row")).alias("least"))
    heads = settled(heads.select("s1", "s2", F.col("least.id").alias("head"), F.col("least.row").alias("head_row")), "heads")
    firsts = small(heads.select("head_row"), heads.count())
    by_class = named.join(firsts, F.col("row") == F.col("head_row"), "left_semi")
    met = blocks(by_class)
    met = settled(met.join(by_class.select("id", "s1", "point", "fine"), ["id", "s1"]), "blocks")

    def links(members: DataFrame, first: bool) -> DataFrame:
        pairs = settled(candidates(members, first), "candidates")
        return settled(verified(pairs, pair_sets(documents, pairs, id_col, text_col)), "links")

    found = links(met.withColumn("label", F.xxhash64("id", "s1")), True)
    joined = settled(components(found.select(node("a").alias("a"), node("b").alias("b")), "a", "b"), "components")
    labels = joined.select(F.col("node.id").alias("id"), F.col("node.s1").alias("s1"), F.xxhash64("component.id", "component.s1").alias("label"))
    labelled = met.join(labels, ["id", "s1"], "left").withColumn("label", F.coalesce("label", F.xxhash64("id", "s1")))
    across = links(labelled, False)
    if not across.isEmpty():
        every = found.union(across).select(node("a").alias("a"), node("b").alias("b"))
        joined = settled(components(every, "a", "b"), "components")
    names = joined.select(F.col("node.id").alias("head"), F.col("node.s1").alias("s1"), F.col("component.id").alias("component"), F.col("component.s1").alias("root"))
    alone = F.col("id").isNull() | (F.col("n") == 0)
    leads = F.col("component").isNull() | ((F.col("component") == F.col("head")) & (F.col("root") == F.col("s1")))
    first = F.coalesce(alone | ((F.col("id") == F.col("head")) & leads), F.lit(False))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.when(F.col("n") > 0, F.col("head")), "id"))
    return (
        rows.select("id", "n", "s1", "s2")
        .join(heads.drop("head_row"), ["s1", "s2"], "left")
        .join(names, ["head", "s1"], "left")
        .select("id", "n", "s1", "s2", component.alias("component"), first.alias("first"))
    )


def linked_documents(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    return row_components(documents, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


@F.arrow_udf(T.StructType([T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]))
def class_of(texts: pa.Array) -> pa.Array:
    """The class of each text, as in ``profiles``."""
    out = []
    for part in tx.chunks(pa.record_batch([texts], ["text"]), 0):
        found, row = shingles(part, 0)
        bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
        own = [np.unique(found[a:b]) for a, b in zip(bounds, bounds[1:])]
        sums = ([x.sum() for x in own], [tx.mixed(x).sum() for x in own])
        out.append(pa.StructArray.from_arrays([pa.array(np.array(x, np.uint64).astype(np.int64)) for x in sums], ["s1", "s2"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("s1", pa.int64()), ("s2", pa.int64())]))


def one_of_each(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay when one of each component does: the smallest id.

    Documents without words and rows with a null id all stay. Rows of one id are told apart
    by their text; of rows that share both, one stays unless the id is null.

    Where the id alone decides, texts are not compared; rows of ids that stand on several rows
    are looked up by their class.
    """
    found = settled(row_components(documents, id_col, text_col).where("id IS NOT NULL"), "found")
    by_id = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("first") & (F.col("n") > 0)).alias("firsts")
    )
    mark, key, of = (fresh(documents, x) for x in ("_drop", "_key", "_class"))
    never = (F.col("firsts") == 0) & (F.col("empty") == 0)
    always = (F.col("empty") == F.col("rows")) | ((F.col("rows") == 1) & (F.col("firsts") == 1))
    marked = by_id.where(~always).select(F.col("id").alias(key), F.when(never, 1).otherwise(2).alias(mark))
    marked = settled(marked, "marked")
    rows = documents.join(small(marked, marked.count()), F.col(id_col) == F.col(key), "left")
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    by_row = marked.where(F.col(mark) == 2)
    if by_row.isEmpty():
        return rows.where(F.col(mark).isNull()).select(documents.columns)
    stay = rows.where(F.col(mark).isNull() | ((F.col(mark) == 2) & ~worded))
    firsts = found.where("first AND n > 0").join(small(by_row, by_row.count()), F.col("id") == F.col(key), "left_semi")
    firsts = settled(firsts.select(F.col("id").alias("_i"), "s1", "s2").distinct(), "firsts")
    told = rows.where((F.col(mark) == 2) & worded).withColumn(of, class_of(F.col(text_col)))
    same = (F.col(id_col) == F.col("_i")) & (F.col(of)["s1"] == F.col("s1")) & (F.col(of)["s2"] == F.col("s2"))
    told = told.join(small(firsts, firsts.count()), same, "left_semi")
    order = Window.partitionBy(id_col, of).orderBy(F.col(text_col))
    told = told.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1)
    return stay.select(documents.columns).unionByName(told.select(documents.columns))
