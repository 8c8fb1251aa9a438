"""Sharding by extendible hashing.

A row's hash is 60 bits of its key's MD5, then 60 bits of its text's. Buckets are prefixes of
that hash. A bucket that holds more bytes than the limit is split on its next bit, others stay
as they are, so shards have different depths and each row's shard is the shortest prefix that
fits. Byte counts are added up per cell, a prefix some bits deeper than shards should be, and
only rows of cells that are too large still are looked at again, some bits deeper.

Rows that share all bits (the same key and text) can't be told apart; they are dealt to pages
of as many rows as fit. A row that is larger than the limit makes a shard of its own and is
marked. Defined cases: a null key is an ordinary key, a null text has no bytes; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmatch.llm.shared import settled, small

BITS = 60
#: Bits by which a cell is deeper than the buckets that it decides on.
STEP = 6


def bits_of(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("\0null")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(depth: Column | int) -> tuple[Column, Column]:
    """The first bits of a row's hash as two numbers."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    h1, h2 = F.col("h1"), F.col("h2")
    return (
        F.when(depth >= BITS, h1).otherwise(F.call_function("shiftright", h1, F.greatest(F.lit(BITS) - depth, F.lit(0)))),
        F.when(depth <= BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", h2, F.lit(2 * BITS) - depth)),
    )


def directory(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """``(c1, c2, depth)`` for each cell of ``high`` bits; depth is null if it doesn't fit.

    Depths from ``low`` to ``high`` are tried; buckets of fewer bits are known not to fit.
    """
    c1, c2 = prefix(high)
    cells = rows.groupBy(c1.alias("h1"), c2.alias("h2")).agg(F.sum("bytes").alias("bytes"))
    cells = settled(cells.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "bytes"), "cells")
    # A cell's own prefixes: its bits are aligned as a row's are.
    full1 = F.call_function("shiftleft", F.col("c1"), F.lit(max(0, BITS - high)))
    full2 = F.call_function("shiftleft", F.col("c2"), F.lit(2 * BITS - high)) if high > BITS else F.lit(0).cast("long")
    levels = cells.withColumn("h1", full1).withColumn("h2", full2)
    levels = levels.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    p1, p2 = prefix(F.col("depth"))
    levels = levels.withColumn("p1", p1).withColumn("p2", p2)
    fits = levels.groupBy("depth", "p1", "p2").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    best = levels.join(fits, ["depth", "p1", "p2"]).groupBy("c1", "c2").agg(F.min("depth").alias("depth"))
    return cells.select("c1", "c2").join(best, ["c1", "c2"], "left")


def sharded(documents: DataFrame, limit: int, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, bytes, depth, shard, shard_bytes, shard_rows, fits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settled(
        documents.select(
            F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), bits_of(F.col(id_col)).alias("h1"), bits_of(text).alias("h2")
        ),
        "sizes",
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    high = min(2 * BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + STEP)
    low, done, left = 0, [], rows
    while True:
        c1, c2 = prefix(high)
        cells = settled(directory(left, limit, low, high), "directory").withColumnRenamed("depth", "_depth")
        placed = left.withColumn("c1", c1).withColumn("c2", c2).join(small(cells, cells.count()), ["c1", "c2"]).drop("c1", "c2")
        done.append(placed.where("_depth IS NOT NULL").withColumnRenamed("_depth", "depth"))
        if high == 2 * BITS:
            done.append(placed.where("_depth IS NULL").withColumn("depth", F.lit(high)).drop("_depth"))
            break
        if cells.where("_depth IS NULL").isEmpty():
            break
        left = settled(placed.where("_depth IS NULL").drop("_depth"), "oversized")
        low, high = high + 1, min(2 * BITS, high + STEP if high < 40 else 2 * BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    p1, p2 = prefix(F.col("depth"))
    bits = F.concat(F.lpad(F.conv(p1.cast("string"), 10, 2), F.least(F.col("depth"), F.lit(BITS)), "0"), F.when(F.col("depth") > BITS, F.lpad(F.conv(p2.cast("string"), 10, 2), F.col("depth") - BITS, "0")).otherwise(F.lit("")))
    out = out.withColumn("shard", F.when(F.col("depth") > 0, bits).otherwise(F.lit("")))
    full = out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    full = settled(full, "shards")
    out = out.join(small(full, full.count()), "shard")
    # Only rows that share all bits are over the limit now: give them pages.
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    whole = out.where(~over)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    paged = out.where(over).withColumn("k", F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1)
    page = F.floor(F.col("k") / each)
    rows_here = F.least(each, F.col("shard_rows") - page * each)
    paged = paged.select(
        F.concat("shard", F.lit("-"), page.cast("string")).alias("shard"), "id", "bytes", "h1", "h2", "depth",
        (rows_here * F.col("bytes")).cast("long").alias("shard_bytes"), rows_here.cast("long").alias("shard_rows"),
    )
    return whole.unionByName(paged).select(
        F.col("id").alias(id_col), "bytes", "depth", "shard", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits")
    )
