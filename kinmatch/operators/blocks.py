"""Work on all combinations of two inputs in bounded blocks.

Some results need every left row compared with every right row (exact nearest
neighbours, fuzzy string closeness). Both inputs are cut into hash buckets of bounded
size; each pair of buckets is one group, handled by one vectorised kernel that emits
only what survives. No group grows with the data.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_blocks(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str,
    right_key: str,
    left_rows: int,
    right_rows: int,
    kernel: Callable,
    schema: str,
) -> DataFrame:
    """Apply ``kernel(left_pdf, right_pdf)`` to each pair of blocks."""
    n_left = max(1, math.ceil(left.count() / left_rows))
    n_right = max(1, math.ceil(right.count() / right_rows))
    left_blocks = left.select(
        "*",
        F.pmod(F.xxhash64(left_key), F.lit(n_left)).alias("_left_block"),
        _each_block(n_right).alias("_right_block"),
    ).groupBy("_left_block", "_right_block")
    right_blocks = right.select(
        "*",
        _each_block(n_left).alias("_left_block"),
        F.pmod(F.xxhash64(right_key), F.lit(n_right)).alias("_right_block"),
    ).groupBy("_left_block", "_right_block")
    return left_blocks.cogroup(right_blocks).applyInPandas(kernel, schema)


def _each_block(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def tidy() -> None:
    """Give freed memory back; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory goes back when they end."""
    try:
        yield from batches
    finally:
        tidy()


def rows_within(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
