"""Quota, rate, version and expiry ledgers over event logs (key, ts, ...). Every window is partitioned by key.

`ts` is a UTC timestamp without zone or with the session zone UTC. Jobs that need the present take it as an
argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..work import sorted_side

PACIFIC = "America/Los_Angeles"


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), PACIFIC))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def quota_ledger(requests: DataFrame) -> DataFrame:
    """(key, day, used, limit, remaining) per Pacific day; requests: (key, ts, limit or null).

    An unknown limit stays null and so does what remains.
    """
    day = requests.withColumn("day", pacific_day(F.col("ts")))
    sums = day.groupBy("key", "day").agg(F.count("*").alias("used"), F.max("limit").alias("limit"))
    return sums.withColumn("remaining", F.when(F.col("limit").isNotNull(), F.greatest(F.col("limit") - F.col("used"), F.lit(0))).cast("long"))


def limit_carry_forward(daily: DataFrame) -> DataFrame:
    """(key, day, used, limit, source): the last limit seen so far holds on; a user's own limit outranks observed ones.

    daily: (key, day, used, user_limit, observed_limit), nulls where nothing was learned that day.
    """
    so_far = W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    user, seen = (F.last(c, ignorenulls=True).over(so_far) for c in ("user_limit", "observed_limit"))
    out = daily.select("key", "day", "used", user.alias("u"), seen.alias("o"))
    source = F.when(F.col("u").isNotNull(), "user").when(F.col("o").isNotNull(), "observed").otherwise("unknown")
    return out.select("key", "day", "used", F.coalesce("u", "o").alias("limit"), source.alias("limit_source"))


def rolling_rate(requests: DataFrame, rpm: int, margin: int = 2, window_ms: int = 60_000) -> DataFrame:
    """(event_id, key, in_window, over, wait_ms): requests in the minute up to each, and the wait that would have kept the rate.

    Times are counted in slots as long as the window, each with the slot before: how many came up to a request, less how many before its window
    began, are two running counts. No row looks through its window, and no task holds more of a key than two windows at a time.
    """
    at = requests.select("event_id", "key", millis(F.col("ts")).alias("ms"))
    allowed = max(1, rpm - margin)
    slot = F.floor(F.col("ms") / window_ms).cast("long")
    ticks = at.groupBy("key", "ms").agg(F.count("*").alias("n"))
    mark = lambda at, slot, t, n: ticks.select("key", slot.alias("slot"), at.alias("at"), t.alias("t"), n.alias("n"), (n == F.col("n")).cast("int").alias("kind"))
    told, none = F.col("ms"), F.lit(None).cast("long")
    marks = mark(told, slot, told, F.col("n")).unionByName(mark(none, slot + 1, told, F.col("n")).where("slot is not null")).unionByName(mark(told, slot, told - window_ms, F.lit(0)))
    of = W.partitionBy("key", "slot")
    so_far = lambda *by: of.orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    up, down = so_far("t", "kind"), so_far(F.desc("t"), F.desc("kind"))
    marks = marks.withColumn("upto", F.sum("n").over(up)).withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(down))
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    seen = marks.where("at is not null or slot is null").groupBy("key", "slot", "at").agg((one(1, "upto") - one(0, "upto")).alias("in_window"), one(0, "next").alias("oldest"))
    seen = seen.select(F.col("key").alias("_key"), F.col("at").alias("_at"), "in_window", "oldest")
    out = at.join(sorted_side(seen), F.col("key").eqNullSafe(F.col("_key")) & F.col("ms").eqNullSafe(F.col("_at")))
    over = F.col("in_window") > allowed
    wait = F.when(over, F.greatest(F.lit(250).cast("long"), F.col("oldest") + window_ms - F.col("ms") + 50)).otherwise(F.lit(0).cast("long"))
    return out.select("event_id", "key", "in_window", over.alias("over"), wait.alias("wait_ms"))


def spacing_gaps(requests: DataFrame, rpm: int) -> DataFrame:
    """Per key: requests, smallest gap, and gaps shorter than floor(60000 / rpm * 0.9) ms."""
    need = int(60_000 / rpm * 0.9)
    ms = millis(F.col("ts"))
    gap = ms - F.lag(ms).over(W.partitionBy("key").orderBy(ms, "event_id"))
    gaps = requests.select("key", gap.alias("gap"))
    return gaps.groupBy("key").agg(F.count("*").alias("n"), F.min("gap").alias("least_gap_ms"), F.sum(F.when(F.col("gap") < need, 1).otherwise(0)).alias("violations"))


def pacing_basis(requests: DataFrame, assumed: int | None = None, fallback: int = 5) -> DataFrame:
    """(event_id, key, rpm, basis): the rate learned so far from headers, else assumed, else the fallback."""
    so_far = W.partitionBy("key").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    out = requests.select("event_id", "key", F.last("rate_header", ignorenulls=True).over(so_far).alias("learned"))
    rest, name = (assumed, "assumption") if assumed else (fallback, "fallback")
    return out.select("event_id", "key", F.coalesce("learned", F.lit(rest)).cast("long").alias("rpm"), F.when(F.col("learned").isNotNull(), "learned").otherwise(name).alias("basis"))


def ttl_split(entries: DataFrame, now: str, hours: int = 48, margin_hours: int = 1) -> DataFrame:
    """(key, expires_at, live): server expiry, else upload plus `hours`, less a margin; live if after `now`.

    entries: (key, uploaded_at, server_expiry as text). A server expiry that is no timestamp counts as missing.
    """
    given = F.try_to_timestamp("server_expiry")
    until = F.coalesce(given, F.col("uploaded_at").cast("timestamp") + F.expr(f"interval {hours} hours")) - F.expr(f"interval {margin_hours} hours")
    return entries.select("key", until.alias("expires_at")).withColumn("live", F.col("expires_at") > F.lit(now).cast("timestamp"))


def retention_purge(touches: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Keys last used more than `days` before `now`: (key, last_used). touches: (key, ts)."""
    last = touches.groupBy("key").agg(F.max(F.col("ts").cast("timestamp")).alias("last_used"))
    return last.where(F.col("last_used") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def version_check(events: DataFrame, idle_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Answers against the state of their frame at that moment: (event_id, key, generation, verdict).

    events: (event_id, key, ts, kind) with kinds navigate (a new generation), scan, remove and answer. A frame is known from a
    navigation or scan on, until it is removed or nothing is heard of it for `idle_ms`; generations count from there. Verdict of an
    answer: gone (not known), not scanned, navigated (the last scan is of an earlier generation), or current.
    """
    by_time = W.partitionBy("key").orderBy("ts", "event_id")
    is_ = lambda *k: F.col("kind").isin(*k)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    # Lives end with a removal; what is not known doesn't begin one, so idleness counts between events of a known frame
    seen = events.select("event_id", "key", "ts", "kind", ms.alias("ms"), F.coalesce(F.lag("kind").over(by_time) == "remove", F.lit(True)).alias("cut"))
    seen = seen.withColumn("part", F.sum(F.col("cut").cast("int")).over(by_time))
    of = W.partitionBy("key", "part").orderBy("ts", "event_id")
    sofar = of.rowsBetween(W.unboundedPreceding, 0)
    began = F.last(F.when(is_("navigate", "scan"), F.col("ms")), ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, -1))
    late = (F.col("ms") - F.lag("ms").over(of) > idle_ms) & began.isNotNull()
    seen = seen.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("life", F.sum(F.col("late").cast("int")).over(sofar))
    life = W.partitionBy("key", "part", "life").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    generation = F.sum(is_("navigate").cast("int")).over(life)
    known = F.max(is_("navigate", "scan").cast("int")).over(life)
    out = seen.select("event_id", "key", "part", "life", "ts", "kind", generation.alias("generation"), known.alias("known"))
    scanned = F.last(F.when(is_("scan"), F.col("generation")), ignorenulls=True).over(life)
    out = out.select("event_id", "key", "kind", "generation", "known", scanned.alias("scanned")).where(is_("answer"))
    verdict = F.when(F.col("known") == 0, "gone").when(F.col("scanned").isNull(), "not scanned").when(F.col("scanned") < F.col("generation"), "navigated").otherwise("current")
    return out.select("event_id", "key", F.when(F.col("known") == 1, F.col("generation")).cast("long").alias("generation"), verdict.alias("verdict"))


def job_snapshot(log: DataFrame) -> DataFrame:
    """Latest state of each (run_id, job) with its place among the run's queued jobs: (run_id, job, state, position).

    log: (event_id, run_id, job, ts, state). Latest by (ts, event_id), aggregated without a sort.
    """
    last = log.groupBy("run_id", "job").agg(F.max(F.struct("ts", "event_id", "state")).alias("last"))
    last = last.select("run_id", "job", F.col("last.state").alias("state"), F.col("last.ts").alias("ts"), F.col("last.event_id").alias("event_id"))
    place = F.row_number().over(W.partitionBy("run_id", "state").orderBy("ts", "event_id"))
    return last.select("run_id", "job", "state", F.when(F.col("state") == "queued", place).cast("long").alias("position"))


def job_results(log: DataFrame) -> DataFrame:
    """What becomes of results (event_id, form_id, run_id, job, outcome) in a log (event_id, form_id, run_id, job, ts, kind).

    kind: start begins a run of the form, which supersedes the one before; queued, running, cancelled change a job of a run; result delivers one.
    outcome: delivered; superseded (another run is live at that time), not running (its job isn't, or was delivered before), no run (none
    is live). Both are as-of lookups: the last start of the form, and the last change of the job, before the result by (ts, event_id).
    """
    is_ = lambda *k: F.col("kind").isin(*k)
    before = lambda *by: W.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    live = F.last(F.when(is_("start"), F.col("run_id")), ignorenulls=True).over(before("form_id"))
    state = F.last(F.when(is_("queued", "running", "cancelled", "result"), F.col("kind")), ignorenulls=True).over(before("form_id", "run_id", "job"))
    seen = log.withColumn("live", live).withColumn("state", state).where(is_("result"))
    outcome = F.when(F.col("live").isNull(), "no run").when(F.col("live") != F.col("run_id"), "superseded").when(F.coalesce("state", F.lit("")) != "running", "not running").otherwise("delivered")
    return seen.select("event_id", "form_id", "run_id", "job", outcome.alias("outcome"))


def error_rollup(responses: DataFrame) -> DataFrame:
    """Responses (provider, status, retry_ms) by kind of error: (provider, kind, n, retryable, longest_retry_ms)."""
    s = F.col("status")
    kind = (
        F.when(s < 400, "ok").when(s == 429, "rate limit").when(s.isin(401, 403), "auth").when(s == 400, "bad request")
        .when(s == 404, "not found").when(s == 413, "too large").when(s == 529, "overloaded").when(s >= 500, "server").otherwise("other")
    )
    retry = kind.isin("rate limit", "overloaded", "server")
    return responses.groupBy("provider", kind.alias("kind")).agg(F.count("*").alias("n"), F.max(retry).alias("retryable"), F.max("retry_ms").alias("longest_retry_ms"))


def preflight(work: DataFrame, ledger: DataFrame, chunk: int = 12) -> DataFrame:
    """Requests that each set's questions take against what remains of its quota: (set_id, requests, verdict, answerable).

    work: (set_id, questions, cached); ledger: (set_id, remaining or null). One request reads documents
    that aren't cached, then one for each chunk of questions.
    """
    need = F.when(F.col("cached"), 0).otherwise(1) + F.ceil(F.col("questions") / chunk)
    out = work.join(ledger, "set_id", "left").select("set_id", "questions", "cached", need.cast("long").alias("requests"), "remaining")
    left = F.greatest(F.col("remaining") - F.when(F.col("cached"), 0).otherwise(1), F.lit(0))
    verdict = (
        F.when(F.col("remaining").isNull(), "unknown limit").when(F.col("requests") > F.col("remaining"), "exceeds")
        .when(F.col("requests") * 5 > F.col("remaining") * 4, "tight").otherwise("ok")
    )
    answerable = F.when(F.col("remaining").isNull(), F.col("questions")).otherwise(F.least(F.col("questions"), left * chunk))
    return out.select("set_id", "requests", verdict.alias("verdict"), answerable.cast("long").alias("answerable"))


# What names a daily limit, a limit per minute, and a free tier; a delay up to this long clears soon.
PER_DAY = r"(?i)per[_ -]?day|perday|\bdaily\b|requests?[_ -]?per[_ -]?day"
PER_MINUTE = r"(?i)per[_ -]?minute|perminute|per[_ -]?min\b|input[_ -]?token[_ -]?count|\brpm\b"
FREE_TIER = r"(?i)free[_ -]?tier"
SHORT_DELAY_MS = 120_000


def quota_window_class(errors: DataFrame) -> DataFrame:
    """(id, window, observed_limit) of quota errors (id, body JSON, retry_ms): daily or per_minute, and the limit that it names.

    A named day counts before a named minute; a bare free tier is per minute if it says to come back within
    SHORT_DELAY_MS, else daily; all else is per minute. The limit is the first positive quotaValue of the violations.
    """
    body = F.coalesce("body", F.lit(""))
    soon = F.coalesce(F.col("retry_ms").between(1, SHORT_DELAY_MS), F.lit(False))
    window = F.when(body.rlike(PER_DAY), "daily").when(body.rlike(PER_MINUTE), "per_minute").when(body.rlike(FREE_TIER) & ~soon, "daily").otherwise("per_minute")
    told = F.from_json(body, "struct<violations:array<struct<quotaValue:string>>>")["violations"]
    values = F.filter(F.transform(told, lambda v: v["quotaValue"].try_cast("bigint")), lambda n: n > 0)
    return errors.select("id", window.alias("window"), F.get(values, 0).alias("observed_limit"))
