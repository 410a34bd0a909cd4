"""What several operators share: reading tables, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most this many rows and bytes may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of results that nothing refers to any more.

    It learns of them when the driver's garbage is collected, which a driver with free memory may not do for half an hour; a job of
    several large shuffles would hold all of them on disk until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _width(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda n, x: n + _width(inner, x).cast("int")), F.lit(0)) + 16
        fields = len(inner.fields) + 2 if isinstance(inner, T.StructType) else 1
        return F.coalesce(F.size(value), F.lit(0)) * (8 * fields) + 16
    return F.lit(8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most `rows` rows and `size` bytes, else df as it is; and which of both."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(8))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("size")).first()
    fits = found["n"] <= rows and (found["size"] or 0) <= size
    return (F.broadcast(df) if fits else df), fits


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def alnum_words(text: Column) -> Column:
    """Array of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null text has none.

    One translate both lower-cases and turns separators into spaces; that is cheaper than a regular expression.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    apart = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
    plain = F.translate(F.coalesce(text, F.lit("")), upper + apart, upper.lower() + " " * len(apart))
    return F.array_remove(F.split(plain, " "), "")


Query = Callable[[SparkSession, str], DataFrame]
