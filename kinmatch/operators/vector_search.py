"""Exact nearest neighbours by cosine distance.

``nearest`` answers one query with array expressions and a top-k. ``nearest_batch``
answers many: up to ``BROADCAST_VALUES`` query values travel to the tasks, every task
keeps the k best per query over all its Arrow batches, and one small shuffle merges
them. A larger query side is joined with the cells of records it cannot rule out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kinmatch.functions import vectors
from kinmatch.operators.blocks import tidied
from kinmatch.operators.pivots import as_matrix, join_by_cells

# Query side limits for broadcasting: 2^24 doubles are 128 MB.
BROADCAST_VALUES = 1 << 24
BROADCAST_QUERIES = 4096
# Block sizes beyond the limits.
QUERY_BLOCK = 2048
RECORD_BLOCK = 32768
# Scores a task holds at once (2^21 doubles are 16 MB), and the most records for them.
TILE_VALUES = 1 << 21
TILE_RECORDS = 2048
# Values of vectors that are gathered at once for the exact distances of pairs.
PAIR_VALUES = 1 << 18


def nearest(
    records: DataFrame,
    query: Sequence[float],
    *,
    key_col: str,
    vector_col: str = "embedding",
    k: int | None = 5,
    threshold: float | None = None,
) -> DataFrame:
    """Records nearest to one query: (key, distance, score), best first.

    ``threshold`` keeps scores at or above it, before the limit. ``k=None`` keeps all.
    """
    query = scaled(np.array([query], dtype=np.float64))[0].tolist()
    query_vector = F.array(*[F.lit(v) for v in query])
    squared_norm = 0.0
    for v in query:
        squared_norm += v * v
    if not math.isfinite(squared_norm):
        squared_norm = 0.0
    distance = vectors.cosine_distance(F.col(vector_col), query_vector, F.lit(squared_norm))
    scored = (
        records.filter(F.col(vector_col).isNotNull())
        .select(key_col, distance.alias("distance"))
        .withColumn("score", vectors.similarity(F.col("distance")))
    )
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    ranked = scored.orderBy("distance", key_col)
    return ranked if k is None else ranked.limit(k)


def _in_order_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, added in element order like the array expressions."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += x * y
    return total


class QueryBlock:
    """Query vectors of one block, with the k best records seen so far per query.

    Records without direction are as far from every query, so their k smallest keys are
    enough; for the queries in ``lost``, which have none themselves, all records are.
    """

    def __init__(self, ids: Sequence, matrix: np.ndarray, k: int, lost: Sequence = ()):
        matrix = scaled(matrix)
        self.ids = ids
        self.lost = lost
        self.matrix = matrix
        self.k = k
        self.far_keys: list = []
        self.all_keys: list = []
        self.norms = _in_order_sum(matrix, matrix)
        self.unit = _unit(matrix, self.norms)
        self.floor = np.full(len(ids), -np.inf)
        self.found: pd.DataFrame | None = None

    def add(self, keys: pd.Series, matrix: np.ndarray) -> None:
        """Take in a batch of records."""
        if self.lost:
            self.all_keys = heapq.nsmallest(self.k, [*self.all_keys, *keys.tolist()])
        if not len(keys) or not len(self.ids):
            return
        known = has_direction(matrix)
        if not known.all():
            self.far_keys = heapq.nsmallest(self.k, [*self.far_keys, *keys[~known].tolist()])
            keys, matrix = keys[known], matrix[known]
            if not len(keys):
                return
        matrix = scaled(matrix)
        if matrix.shape[1] != self.matrix.shape[1]:
            raise ValueError(
                f"vector sizes differ: {matrix.shape[1]} and {self.matrix.shape[1]}"
            )
        norms = _in_order_sum(matrix, matrix)
        rough = self.unit @ _unit(matrix, norms).T
        # Matrix products add in another order, so keep all within the rounding error
        # of the k-th best and rank those by the exact distance.
        slack = 1e-15 * matrix.shape[1] + 1e-12
        limit = self.floor - slack
        near = rough >= limit[:, None]
        if len(keys) > self.k and near.sum() > self.k * len(self.ids):
            kth = np.partition(rough, len(keys) - self.k, axis=1)[:, len(keys) - self.k]
            near = rough >= np.maximum(limit, kth - slack)[:, None]
        q, r = np.nonzero(near)
        for part in range(0, len(q), 1 << 16):
            self._merge(q[part : part + (1 << 16)], r[part : part + (1 << 16)], keys, matrix, norms)

    def _merge(self, q, r, keys, matrix, norms):
        scale = np.sqrt(self.norms[q] * norms[r])
        # the vectors of a few pairs at a time: a pair takes two whole vectors
        step = max(64, PAIR_VALUES // matrix.shape[1])
        sums = [_in_order_sum(self.matrix[q[a : a + step]], matrix[r[a : a + step]]) for a in range(0, len(q), step)]
        cosine = np.clip(np.concatenate(sums) / scale, -1.0, 1.0)
        rows = pd.DataFrame({"q": q, "key": keys.to_numpy()[r], "distance": 1.0 - cosine})
        if self.found is not None:
            rows = pd.concat([self.found, rows], ignore_index=True)
        rows = rows.sort_values(["q", "distance", "key"], kind="stable")
        self.found = rows.groupby("q", sort=False).head(self.k).reset_index(drop=True)
        full = self.found.groupby("q")["distance"].agg(["size", "last"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = 1.0 - full["last"].to_numpy()

    def rows(self) -> pd.DataFrame:
        """What was found; keys of records without direction fill up what lacks k hits."""
        found = self.found if self.found is not None else pd.DataFrame({"q": [], "key": [], "distance": []})
        ids = pd.Series(self.ids, dtype=object)
        parts = [
            pd.DataFrame(
                {
                    "query": ids.iloc[found["q"].astype(int)].to_numpy(),
                    "key": found["key"],
                    "distance": found["distance"],
                }
            )
        ]
        if self.far_keys:
            hits = np.bincount(found["q"].astype(int), minlength=len(ids))
            parts += [self._far(ids[i], self.far_keys[: self.k - n]) for i, n in enumerate(hits) if n < self.k]
        parts += [self._far(q, self.all_keys) for q in self.lost if self.all_keys]
        parts = [p for p in parts if len(p)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"query": [], "key": [], "distance": []})

    @staticmethod
    def _far(query, keys: list) -> pd.DataFrame:
        return pd.DataFrame({"query": pd.Series([query] * len(keys), dtype=object), "key": keys, "distance": np.nan})


def tile_starts(records: int, queries: int) -> tuple[range, int]:
    """Where the tiles of so many records begin, and how many records one has."""
    size = max(64, min(TILE_RECORDS, TILE_VALUES // max(queries, 1)))
    return range(0, records, size), size


def _unit(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    return matrix / np.sqrt(norms)[:, None]


def has_direction(matrix: np.ndarray) -> np.ndarray:
    """Which rows are finite and not all zero; ``vectors.directed`` for a matrix."""
    return np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Directed rows of no ordinary length scaled by a power of two, as ``vectors.scaled``."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        norms = _in_order_sum(matrix, matrix)
    low, high = vectors.ORDINARY
    odd = has_direction(matrix) & ~((norms >= low) & (norms <= high))
    if not odd.any():
        return matrix
    out = matrix.copy()
    power = np.clip(np.frexp(np.abs(matrix[odd]).max(axis=1))[1] - 1, -1000, 1000)
    out[odd] = np.ldexp(matrix[odd], -power[:, None])
    return out


def nearest_batch(
    queries: DataFrame,
    records: DataFrame,
    *,
    query_col: str,
    key_col: str,
    vector_col: str = "embedding",
    query_vector_col: str | None = None,
    k: int = 5,
    threshold: float | None = None,
) -> DataFrame:
    """The k nearest records of every query: (query, rank, key, distance, score).

    NULL vectors on either side take no part. Ties rank by key. Vectors without a direction
    (all values zero, or one that is not finite) have a NaN distance to all others and rank
    after every other record, as in ``nearest``.
    """
    return _nearest_batch(
        queries, records, query_col=query_col, key_col=key_col, vector_col=vector_col,
        query_vector_col=query_vector_col, k=k, threshold=threshold,
    )[0]


def _nearest_batch(
    queries, records, *, query_col, key_col, vector_col, query_vector_col=None, k, threshold=None
) -> tuple[DataFrame, bool]:
    """``nearest_batch``, and whether the number of queries is proven small."""
    query_vector_col = query_vector_col or vector_col
    queries = queries.filter(F.col(query_vector_col).isNotNull()).select(
        F.col(query_col).alias("query"), F.col(query_vector_col).alias("query_vector")
    )
    records = records.filter(F.col(vector_col).isNotNull()).select(
        F.col(key_col).alias("key"), F.col(vector_col).alias("vector")
    )
    query_type = queries.schema["query"].dataType.simpleString()
    key_type = records.schema["key"].dataType.simpleString()
    schema = f"query {query_type}, key {key_type}, distance double"

    small = _small_query_side(queries)
    if small is not None:
        ids, matrix = small
        known = has_direction(matrix)
        asked = [q for q, keep in zip(ids, known) if keep], matrix[known]
        lost = [q for q, keep in zip(ids, known) if not keep]
        hits = _stream_records(asked, lost, records, k, schema)
    else:
        toward, asked = vectors.directed(F.col("vector")), vectors.directed(F.col("query_vector"))
        lost = not queries.filter(~asked).isEmpty()
        hits = join_by_cells(
            queries.filter(asked).withColumn("query_vector", _ordinary("query_vector")),
            records.filter(toward).withColumn("vector", _ordinary("vector")),
            k, _block_kernel(k), schema, query_block=QUERY_BLOCK, record_block=RECORD_BLOCK,
        ).unionByName(_without_direction(queries, records, k, lost))
    # pandas hands NaN over as NULL, which would sort first
    hits = hits.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))
    hits = hits.withColumn("score", vectors.similarity(F.col("distance")))
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    best = Window.partitionBy("query").orderBy("distance", "key")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    result = ranked.select(
        F.col("query").alias(query_col), "rank", F.col("key").alias(key_col), "distance", "score"
    )
    return result, small is not None


def _ordinary(name: str) -> Column:
    """Vectors in doubles, those of no ordinary length scaled."""
    v = F.col(name)
    return F.when(vectors.squared_norm(v).between(*vectors.ORDINARY), v.cast("array<double>")).otherwise(vectors.scaled(v))


def _without_direction(queries: DataFrame, records: DataFrame, k: int, lost: bool) -> DataFrame:
    """Hits with a NaN distance: at most k keys a query, the smallest ones.

    Records without direction are needed where fewer than k have one; a query without
    direction (``lost``: there are such) is as far from every record.
    """
    toward = F.col("vector")
    missing = k - records.filter(vectors.directed(toward)).select("key").limit(k).count()

    def least(rows: DataFrame, n: int) -> Column:
        kind = records.schema["key"].dataType
        keys = [r["key"] for r in rows.select("key").orderBy("key").limit(n).collect()] if n > 0 else []
        return F.array(*[F.lit(v).cast(kind) for v in keys]).cast(ArrayType(kind))

    filling = least(records.filter(~vectors.directed(toward)), missing)
    every = least(records, k if lost else 0)
    keys = F.when(vectors.directed(F.col("query_vector")), filling).otherwise(every)
    return queries.select("query", F.explode(keys).alias("key"), F.lit(float("nan")).alias("distance"))


def _small_query_side(queries: DataFrame) -> tuple[list, np.ndarray] | None:
    """Ids and vectors when they are few enough to broadcast."""
    table = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    if table.num_rows > BROADCAST_QUERIES:
        return None
    matrix = as_matrix(table.column("query_vector"))
    return (table.column("query").to_pylist(), matrix) if matrix.size <= BROADCAST_VALUES else None


def _stream_records(small, lost: list, records: DataFrame, k: int, schema: str) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast((*small, lost))
    fields = records.sparkSession.createDataFrame([], schema).schema

    def best_of_partition(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        ids, matrix, lost = shared.value
        block = QueryBlock(ids, matrix, k, lost)
        for batch in batches:
            starts, size = tile_starts(batch.num_rows, len(ids))
            for part in (batch.slice(start, size) for start in starts):
                block.add(part.column("key").to_pandas(), as_matrix(part.column("vector")))
        found = block.rows()
        if len(found):
            table = pa.Table.from_pandas(
                found, schema=to_arrow_schema(fields), preserve_index=False
            )
            yield from table.to_batches()

    return records.mapInArrow(lambda batches: tidied(best_of_partition(batches)), schema)


def _block_kernel(k: int):
    def kernel(queries: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(records):
            return pd.DataFrame({"query": [], "key": [], "distance": []})
        block = QueryBlock(
            queries["query"].tolist(), np.stack(queries["query_vector"]).astype(np.float64), k
        )
        starts, size = tile_starts(len(records), len(queries))
        for start in starts:
            part = records.iloc[start : start + size]
            block.add(part["key"], np.stack(part["vector"]).astype(np.float64))
        return block.rows()

    return kernel
