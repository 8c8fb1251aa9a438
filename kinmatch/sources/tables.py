"""Reading and publishing record tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same, spread over the cluster when the files give too few tasks for costly rows.

    A table of many splits stays as it is, so this never shuffles large data.
    """
    df = read_table(spark, folder, name)
    wanted = spark.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; give partitionColumn, bounds and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def newest_rows(df: DataFrame, *, order_col: str, key_col: str) -> DataFrame:
    """Full scan, newest first; the key settles ties."""
    return df.orderBy(F.desc(order_col), key_col)


def create_table(
    spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType, path: str
) -> DataFrame:
    """Write inline seed rows with an explicit schema and read them back."""
    spark.createDataFrame(rows, schema).write.mode("errorifexists").parquet(path)
    return spark.read.schema(schema).parquet(path)


def publish(df: DataFrame, root: str) -> str:
    """Write a new version next to the earlier ones and return its path.

    The directory being read is never overwritten; a lost task only costs a retry.
    """
    path = f"{root}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster must name one,
    since executors don't see what others write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinmatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Written to the shared folder and read back.

    For tables used several times: they are computed once, a lost executor costs nothing,
    and the planner knows their size.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Project to the columns of ``names`` under their new names; dates become text."""
    types = {f.name: f.dataType for f in df.schema}

    def value(name) -> Column:
        if isinstance(types[name], T.DateType):
            return F.date_format(name, "yyyy-MM-dd")
        return F.col(name)

    return df.select(*[value(old).alias(new) for old, new in names.items()])


def as_json(df: DataFrame, columns: Sequence[str], name: str = "json") -> DataFrame:
    """Add the columns as one JSON text; non-ASCII characters stay as they are."""
    return df.withColumn(name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def write_json_lines(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(column).write.mode("errorifexists").text(path)
