"""Folders and tables that jobs write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors must share; only a local session without the setting gets a
    temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores by `by`, in a number of partitions that isn't cut by their bytes: for rows that are few bytes and much work.

    A table of small rows lies in one file and is read by one task, whatever is made of its rows after that.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of joins that is shuffled and sorted, never sent to the driver.

    Spark estimates what is exploded or aggregated from a table by the bytes of its file and would broadcast it, a hundred times
    larger, through the driver.
    """
    return df.hint("merge")


def counted_side(df: DataFrame, rows: int = 100_000, size: int = 16 << 20) -> DataFrame:
    """df, of strings and numbers, as a side of joins: broadcast if it was counted to have at most `rows` rows and `size` bytes, else a sorted side."""
    width = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields), F.lit(32))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else sorted_side(df)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: its lineage ends there."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
