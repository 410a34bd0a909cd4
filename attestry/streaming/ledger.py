"""The day ledger over a stream of requests (key, ts), and running streams over what is there.

Lateness is our choice: a request may come two hours late by its own clock, more than the hour that local
time falls back in autumn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledgers import PACIFIC

LATENESS = "2 hours"


def day_counts(requests: DataFrame) -> DataFrame:
    """(key, day, used) per Pacific day; update or complete mode."""
    local = requests.withColumn("local_ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), PACIFIC)).withWatermark("local_ts", LATENESS)
    counts = local.groupBy("key", F.window("local_ts", "1 day").alias("w")).agg(F.count("*").alias("used"))
    return counts.select("key", F.to_date("w.start").alias("day"), "used")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs the stream over what is there now and returns its rows with the trigger that gave them, `_batch`; state and rows lie under `path`."""
    out = f"{path}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/b={number}")  # a repeated batch overwrites itself

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)  # what list states and timers are kept in
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(out).drop("b")
