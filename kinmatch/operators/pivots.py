"""Exact pruning for nearest-neighbour joins whose two sides are both large.

Records are assigned to the nearest of some pivot records. On unit vectors the cosine order
is the Euclidean order, so the triangle inequality gives, per query, an upper bound of its
k-th distance and lower bounds for all records of a cell. A query only meets the cells it
cannot rule out, which saves most work on clustered data and loses nothing on any data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.operators.blocks import tidied
from kinmatch.sources.tables import settled

# Bounds are compared with this slack, far above their rounding error.
SLACK = 1e-6
MIN_PIVOTS, MAX_PIVOTS = 16, 1024
# Records without length have no direction and form a cell of their own.
NO_DIRECTION = -1
# Rows whose distances to all pivots are held at once.
ASSIGNED_ROWS = 1024


def as_matrix(column) -> np.ndarray:
    """A float64 matrix from a non-null Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return np.zeros((0, 0))
    if len(values) % n or (np.diff(column.offsets.to_numpy()) != len(values) // n).any():
        raise ValueError("vectors of different sizes in one column; resize them first")
    return values.reshape(n, -1)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length one, which rows have a length)."""
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(length > 0, length, 1.0)[:, None], length > 0


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (rows @ pivots.T), 0.0))


def join_by_cells(
    queries: DataFrame, records: DataFrame, k: int, kernel, schema: str,
    *, query_block: int, record_block: int,
) -> DataFrame:
    """``kernel`` applied to bounded blocks of (query, query_vector) and (key, vector)
    that together hold every query's k nearest records."""
    spark = records.sparkSession
    wanted = math.ceil(records.count() / record_block)
    chosen = (
        records.orderBy(F.xxhash64("key"), "key")
        .limit(min(max(wanted, MIN_PIVOTS), MAX_PIVOTS))
        .select("vector")
        .toArrow()
    )
    pivots, has_length = unit(as_matrix(chosen.column("vector")))
    pivots = np.unique(pivots[has_length], axis=0) if len(pivots) else pivots

    celled = settled(_assigned(records, spark.sparkContext.broadcast(pivots)))
    closest = Window.partitionBy("cell").orderBy("radius")
    # at most pivots x k rows
    near = (
        celled.select("cell", "radius")
        .withColumn("place", F.row_number().over(closest))
        .filter(F.col("place") <= k)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("radius")).alias("smallest"))
        .collect()
    )
    sizes = {
        r["cell"]: (r["n"], r["reach"])
        for r in celled.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("reach"))
        .collect()
    }
    cells = _Cells(pivots, {r["cell"]: r["smallest"] for r in near}, sizes, k)
    met = settled(_met_cells(queries, spark.sparkContext.broadcast(cells)))
    asked = {r["cell"]: r["count"] for r in met.groupBy("cell").count().collect()}
    blocks = {
        cell: (math.ceil(n / query_block), math.ceil(sizes[cell][0] / record_block))
        for cell, n in asked.items()
    }
    if not blocks:
        return spark.createDataFrame([], schema)

    def count_of(side):
        pairs = [F.lit(v) for cell, n in blocks.items() for v in (cell, n[side])]
        return F.try_element_at(F.create_map(*pairs), F.col("cell"))

    def each(side):
        # cells that no query meets have no count, hence no rows
        return F.explode(F.sequence(F.lit(0), count_of(side) - 1))

    def own(column, side):
        return F.pmod(F.xxhash64(column), count_of(side)).cast("int")

    left = met.select("*", own("query", 0).alias("_q"), each(1).alias("_r"))
    right = celled.select("key", "vector", "cell", own("key", 1).alias("_r"), each(0).alias("_q"))
    group = ["cell", "_q", "_r"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(kernel, schema)


def _assigned(records: DataFrame, shared) -> DataFrame:
    """Records with the ``cell`` of their nearest pivot and the distance to it."""
    key_type = records.schema["key"].dataType.simpleString()
    vector_type = records.schema["vector"].dataType.simpleString()

    def assign(batches):
        pivots = shared.value
        for batch in (b.slice(at, ASSIGNED_ROWS) for b in batches for at in range(0, b.num_rows, ASSIGNED_ROWS)):
            rows, has_length = unit(as_matrix(batch.column("vector")))
            cell = np.full(len(rows), NO_DIRECTION, dtype=np.int32)
            radius = np.zeros(len(rows))
            if len(pivots):
                distance = _distances(rows, pivots)
                nearest = distance.argmin(axis=1)
                cell = np.where(has_length, nearest, NO_DIRECTION).astype(np.int32)
                radius = np.where(has_length, distance[np.arange(len(rows)), nearest], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("vector"), pa.array(cell), pa.array(radius)],
                names=["key", "vector", "cell", "radius"],
            )

    return records.select("key", "vector").mapInArrow(
        lambda batches: tidied(assign(batches)), f"key {key_type}, vector {vector_type}, cell int, radius double"
    )


class _Cells:
    """What a task needs to know about all cells to rule some out."""

    def __init__(self, pivots, smallest, sizes, k):
        self.k = k
        self.all = np.array(sorted(sizes), dtype=np.int32)
        self.ids = self.all[self.all != NO_DIRECTION]
        self.pivots = pivots[self.ids] if len(self.ids) else pivots[:0]
        self.reach = np.array([sizes[c][1] for c in self.ids])
        self.enough = sum(sizes[c][0] for c in self.ids) >= k
        # k smallest radii per cell, missing ones infinitely far
        self.smallest = np.full((len(self.ids), k), np.inf)
        for row, c in zip(self.smallest, self.ids):
            row[: len(smallest[c])] = smallest[c]
        self.between = _distances(self.pivots, self.pivots)

    def met_by(self, query: np.ndarray) -> np.ndarray:
        """Cells that may hold one of the k nearest records of one unit query."""
        distance = _distances(query[None, :], self.pivots)[0]
        bounds = (distance[:, None] + self.smallest).ravel()
        limit = np.partition(bounds, self.k - 1)[self.k - 1] + SLACK
        home = distance.argmin()
        # beyond the plane half-way between the home pivot and the cell's; pivots that are one
        # but for rounding have none
        apart = self.between[home] > SLACK
        plane = np.zeros(len(distance))
        plane[apart] = (distance[apart] ** 2 - distance[home] ** 2) / (2 * self.between[home][apart])
        lower = np.maximum(distance - self.reach, plane)
        return self.ids[lower <= limit]


def _met_cells(queries: DataFrame, shared) -> DataFrame:
    """One row per query and cell it must meet: (query, query_vector, cell)."""
    query_type = queries.schema["query"].dataType.simpleString()
    vector_type = queries.schema["query_vector"].dataType.simpleString()

    def meet(batches):
        cells = shared.value
        for batch in batches:
            rows, has_length = unit(as_matrix(batch.column("query_vector")))
            if len(rows) and len(cells.pivots) and rows.shape[1] != cells.pivots.shape[1]:
                raise ValueError(
                    f"vector sizes differ: {cells.pivots.shape[1]} and {rows.shape[1]}"
                )
            # without a direction, or with too few records, nothing can be ruled out
            met = [
                cells.met_by(row) if directed and cells.enough else cells.all
                for row, directed in zip(rows, has_length)
            ]
            # bounded output batches: a query may meet many cells
            for start in range(0, len(met), 256):
                part = met[start : start + 256]
                taken = pa.array(np.repeat(np.arange(start, start + len(part)), [len(c) for c in part]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query").take(taken),
                        batch.column("query_vector").take(taken),
                        pa.array(np.concatenate(part).astype(np.int32)),
                    ],
                    names=["query", "query_vector", "cell"],
                )

    return queries.select("query", "query_vector").mapInArrow(
        lambda batches: tidied(meet(batches)), f"query {query_type}, query_vector {vector_type}, cell int"
    )
