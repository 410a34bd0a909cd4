"""Stateful jobs over the touches of keys (key, ts) whose result doesn't depend on the order in which they come.

As in `in_order`, keys are put into groups; here what a group remembers of all its keys is one table, kept as one value that is read and written
once a trigger and worked on in columns. A row of state for every key and window costs more than all the counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .in_order import GROUPS
from .ledger import LATENESS


def micros(spark, length: str) -> int:
    """An interval of days or less, such as "10 minutes", in microseconds."""
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {length}"))).first()[0]


class _Grouped(StatefulProcessor):
    """Touches (key, us) of a group of keys; `us` is the time in microseconds, a key is text. `kept` is the schema of what is remembered."""

    kept: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def _load(self) -> pd.DataFrame:
        found = self.held.get() if self.held.exists() else None
        if found is None:
            return self.kept.empty_table().to_pandas()
        with pa.ipc.open_stream(found[0]) as rows:
            return rows.read_pandas()

    def _store(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.held.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.kept) as out:
            out.write_table(pa.Table.from_pandas(rows, self.kept, preserve_index=False))
        self.held.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


class _Rates(_Grouped):
    """Remembered: the touches in windows that are still open."""

    kept = pa.schema([("key", pa.string()), ("us", pa.int64())])

    def __init__(self, window: int, slide: int, over: int):
        self.window, self.slide, self.over = window, slide, over

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([b[["key", "us"]] for b in rows], ignore_index=True)
        before = self._load()
        both = pd.concat([before, new], ignore_index=True) if len(before) else new
        self._prune(both, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(int(new["us"].max() + self.window) // 1000 + 1)
        yield self._counts(both, len(before))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._prune(self._load(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "us": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def _prune(self, rows: pd.DataFrame, mark: int) -> None:
        self._store(rows[rows["us"] + self.window > mark * 1000])

    def _counts(self, rows: pd.DataFrame, old: int) -> pd.DataFrame:
        """Windows with a touch beyond the first `old` rows, and more than `over` touches."""
        codes, keys = pd.factorize(rows["key"], use_na_sentinel=False)
        us = rows["us"].to_numpy()
        steps = -(-self.window // self.slide)
        start = (us // self.slide)[:, None] - np.arange(steps)
        inside = start * self.slide + self.window > us[:, None]
        at = pd.DataFrame({"code": np.repeat(codes, steps)[inside.ravel()], "start": start.ravel()[inside.ravel()]})
        at["new"] = np.repeat(np.arange(len(us)) >= old, steps)[inside.ravel()]
        found = at.groupby(["code", "start"], sort=False)["new"].agg(["size", "any"]).reset_index()
        found = found[(found["size"] > self.over) & found["any"]]
        return pd.DataFrame({"key": np.asarray(keys, dtype=object)[found["code"]], "us": found["start"].to_numpy() * self.slide, "n": found["size"].astype("int64").to_numpy()})


class _Lives(_Grouped):
    """Remembered: the lives that the watermark hasn't passed."""

    kept = pa.schema([("key", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64())])

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pd.DataFrame({"key": b["key"], "start": b["us"], "end": b["us"] + self.ttl, "n": 1}) for b in rows], ignore_index=True)
        self._remember(self._joined(pd.concat([self._load(), new], ignore_index=True)))
        yield new.iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lives = self._load()
        over = lives["end"] <= timerValues.getCurrentWatermarkInMs() * 1000
        if over.any():
            self._remember(lives[~over])
        yield lives[over]

    def _remember(self, lives: pd.DataFrame) -> None:
        self._store(lives)
        if len(lives):
            self.handle.registerTimer(-(-int(lives["end"].min()) // 1000) + 1)

    @staticmethod
    def _joined(lives: pd.DataFrame) -> pd.DataFrame:
        """Lives that begin before another of their key has ended are one."""
        codes, keys = pd.factorize(lives["key"], use_na_sentinel=False)
        rows = lives.assign(code=codes).sort_values(["code", "start"], kind="stable", ignore_index=True)
        ended = rows.groupby("code", sort=False)["end"].cummax().groupby(rows["code"], sort=False).shift()
        # a key's first life has no end before it
        own = (ended.isna() | (rows["start"] >= ended.fillna(0).astype("int64"))).cumsum()
        out = rows.groupby(own, sort=False).agg(code=("code", "first"), start=("start", "first"), end=("end", "max"), n=("n", "sum"))
        return pd.DataFrame({"key": np.asarray(keys, dtype=object)[out["code"]], **{c: out[c].to_numpy() for c in ("start", "end", "n")}})


def _run(touches: DataFrame, processor: _Grouped, schema: str, mode: str) -> DataFrame:
    kind, at = touches.schema["key"].dataType, F.col("ts").cast("timestamp")
    rows = touches.where(at.isNotNull()).select(F.col("key").cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).withWatermark("ts", LATENESS)
    return rows.groupBy("group").transformWithStateInPandas(processor, schema, mode, "eventTime").withColumn("key", F.col("key").cast(kind))


def rate_alerts(requests: DataFrame, rpm: int, margin: int = 2, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(key, start, n) of sliding windows with more requests (key, ts) than max(1, rpm - margin); update mode: a window is told again when it grows."""
    spark = requests.sparkSession
    job = _Rates(micros(spark, window), micros(spark, slide), max(1, rpm - margin))
    return _run(requests, job, "key string, us bigint, n bigint", "Update").select("key", F.timestamp_micros("us").alias("start"), "n")


def lives(touches: DataFrame, ttl: str) -> DataFrame:
    """(key, start, expires_at, n): cache entries of touches (key, ts); each touch extends an entry's life by `ttl`, and one
    that comes after it begins another. Append mode: a life is given once the watermark has passed it, and forgotten."""
    job = _Lives(micros(touches.sparkSession, ttl))
    out = _run(touches, job, "key string, start bigint, end bigint, n bigint", "Append")
    return out.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("expires_at"), "n")
