"""Helpers of the training-data operators: shared storage, names, joins, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.sources.tables import new_folder, read_table, settled, shared_folder

__all__ = ["components", "crc32_of", "fresh", "new_folder", "read_table", "settled", "shared_folder", "small"]

#: Bytes up to which a table of ids and digests travels to every executor.
BROADCAST_BYTES = 32 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(kind: T.DataType) -> int:
    """Bytes that a value of a type takes, a digest in hex digits for every text."""
    if isinstance(kind, T.StructType):
        return sum(width(field.dataType) for field in kind)
    return 80 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table for broadcast if its counted rows, by their width, stay within the bound."""
    return F.broadcast(df) if rows * (24 + width(df.schema)) <= BROADCAST_BYTES else df


def crc32_of(column: str | Column) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself: further steps change nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: ``(node, component)`` with the smallest node of each component.

    Large-star and small-star steps alternate until every edge leads to a root. A step groups the edges
    of one node; what leaves it are links to the smallest neighbour, so hubs shrink at once
    (``min`` combines before the shuffle). Every step is written to the shared folder.
    Null nodes and self links are ignored; an empty table gives an empty result.
    """
    current = settled(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .distinct(),
        "edges",
    )
    while not _are_stars(current):
        both = current.union(current.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        current = settled(
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct(),
            "edges",
        )
    nodes = current.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node")).distinct()
    return nodes.withColumnRenamed("u", "node").union(
        roots.select("node", F.col("node").alias("component"))
    )
