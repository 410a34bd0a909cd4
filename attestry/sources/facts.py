"""Reading document folders and writing facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files under path/set_id/ as (set_id, file_name, text), one row a file."""
    rows = spark.read.text(f"{path.rstrip('/')}/*/*", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.element_at(parts, -2).alias("set_id"), F.element_at(parts, -1).alias("file_name"), F.col("value").alias("text"))


#: Kinds of files by extension; the first that matches counts.
KINDS = {
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff", "heic"),
    "text": ("txt", "md", "csv", "json", "xml", "html", "htm"),
    "office": ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt"),
    "archive": ("zip", "rar", "7z", "tar", "gz"),
    "media": ("mp3", "wav", "mp4", "mov", "webm", "m4a"),
}


def kind_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*e), F.lit(k)) for k, e in KINDS.items()], F.lit("unsupported"))


def file_inventory(files: DataFrame, pdf_limit: int = 50 << 20, any_limit: int = 2 << 30, media_limit: int = 100 << 20) -> DataFrame:
    """(kind, n, bytes, rejected): files (file_name, length) by kind, and those that are empty or too large."""
    sized = files.select(kind_of(F.col("file_name")).alias("kind"), F.col("length").cast("long").alias("length"))
    limit = F.when(F.col("kind") == "pdf", pdf_limit).when(F.col("kind") == "media", media_limit).otherwise(any_limit)
    bad = (F.col("length") == 0) | (F.col("length") > limit)
    return sized.groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(F.when(bad, 1).otherwise(0)).alias("rejected"))


def write_facts(facts: DataFrame, path: str) -> None:
    """Replaces the partitions of the sets in `facts`; other sets stay."""
    facts.repartition("set_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a report in its order as JSON lines, or as CSV with a header."""
    report.write.mode("overwrite").option("header", True).option("ignoreNullFields", False).format(kind).save(path)
