"""Streams over several triggers with late rows against their batch twins, and state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import ledgers
from attestry.streaming import in_order
from attestry.streaming.ledger import ROCKSDB

MINUTE = 60
SCHEMA = "event_id long, key long, ts timestamp, kind string"


@pytest.fixture
def log(spark):
    """(rows, files): 40 keys, removed again and again, with idle times; files overlap by half an hour."""
    rng, rows, event = random.Random(3), [], 0
    for key in range(40):
        at = rng.randrange(0, 3600)
        for _ in range(rng.randrange(3, 12)):
            event += 1
            rows.append((event, key, at, rng.choice(["navigate", "scan", "scan", "answer", "answer", "answer", "navigate", "remove"])))
            at += rng.choice([0, 1, 20 * MINUTE, 20 * MINUTE, 2 * 3600, 9 * 3600])
    rows.append((event + 1, 0, rows[0][2], "answer"))  # a tie in time
    last = max(r[2] for r in rows)
    files = [[] for _ in range(5)]
    for r in rows:
        slot = min(4, 5 * r[2] // last)
        late = slot < 4 and 5 * (r[2] + 30 * MINUTE) // last > slot and rng.random() < 0.5
        files[slot + late].append(r)
    files.append([(-1, -1, last + 10 * 24 * 3600, "end")])
    return rows, files


def replay(spark, tmp_path, files, run):
    """The rows of a stream over one file a trigger, and how many rows of state there were after each."""
    for i, rows in enumerate(files):
        rng = random.Random(i)
        rng.shuffle(rows)
        spark.createDataFrame(rows, "event_id long, key long, s long, kind string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    return [tuple(r) for r in spark.table("replayed").collect()], state, dropped


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_versions_over_several_triggers(spark, tmp_path, log):
    rows, files = log
    idle = 8 * 3600 * 1000
    got, state, dropped = replay(spark, tmp_path, files, lambda s: in_order.versions(s, idle))
    assert dropped == 0
    batch = spark.createDataFrame(rows, "event_id long, key long, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    want = plain(ledgers.version_check(batch, idle).collect())
    assert plain(got) == want
    assert {r[3] for r in want} == {"gone", "not scanned", "navigated", "current"}
    assert len(got) == len({r[0] for r in got})  # no answer twice
    assert max(state) >= 40 and state[-1] <= 2  # what was removed or idle is forgotten; the last event waits


def test_admission_depends_on_the_jobs_times_alone(spark, tmp_path, log):
    rows, files = log
    horizon = 3600 * 1000
    got, state, _ = replay(spark, tmp_path, files, lambda s: in_order.admitted_once(s, horizon))
    want, since = [], {}
    for event, key, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in since or (at - since[key]) * 1000 > horizon:
            since[key] = at
            want.append((event, key))
    assert plain(r for r in got if r[1] >= 0) == plain(want)
    assert state[-1] <= 2


def test_what_comes_too_late_is_dropped(spark, tmp_path):
    files = [[(1, 1, 0, "scan"), (2, 1, 10 * 3600, "answer")], [(4, 1, 9 * 3600, "navigate")], [(3, 1, 3600, "remove"), (5, 1, 90 * 3600, "scan")], [(6, 1, 91 * 3600, "scan")]]
    got, _, dropped = replay(spark, tmp_path, files, lambda s: in_order.versions(s))
    assert dropped == 1  # the removal, seven hours behind the watermark
    assert got == [(2, 1, 1, "navigated")]


def drain(spark, path, files, run, mode, a_trigger):
    """Rows of a stream over `files` (lists of (event_id, key, s)), so many a trigger."""
    from attestry.streaming import ledger

    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "event_id long, key long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_699_999_200)).drop("s").coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = run(spark.readStream.schema("event_id long, key long, ts timestamp").option("maxFilesPerTrigger", a_trigger).option("recursiveFileLookup", True).parquet(f"{path}/in"))
    return ledger.drained(spark, stream, path, mode).collect()


@pytest.fixture
def touches():
    """(rows, files): touches of 30 keys, the null key too, with ties and gaps; a few of each file come with the next."""
    rng, rows = random.Random(8), []
    for key in [None, *range(30)]:
        at = rng.randrange(0, 3600)
        for _ in range(25):
            rows.append((len(rows), key, at))
            at += rng.choice([0, 30, 599, 600, 3600, 5 * 3600, 6 * 3600, 9 * 3600])
    last = max(r[2] for r in rows)
    files = [[] for _ in range(5)]
    for r in rows:
        slot = min(4, 5 * r[2] // last)
        files[slot + (slot < 4 and r[0] % 3 == 0 and 5 * (r[2] + 3600) // last > slot)].append(r)
    return rows, [*files, [(-1, -1, last + 2 * 24 * 3600)]]


@pytest.mark.parametrize("a_trigger", [1, 2])
def test_rate_windows_need_no_row_of_state_each(spark, tmp_path, touches, a_trigger):
    from attestry.streaming import grouped

    rows, files = touches
    out = drain(spark, tmp_path, files, lambda s: grouped.rate_alerts(s, rpm=3, window="1 hour", slide="10 minutes"), "update", a_trigger)
    got, want = {}, {}
    for r in sorted(out, key=lambda r: r["_batch"]):
        got[r.key, int(r.start.timestamp())] = r.n
    for _, key, s in rows:
        for i in range(6):
            at = key, ((s + 1_699_999_200) // 600 - i) * 600
            want[at] = want.get(at, 0) + 1
    assert got == {k: n for k, n in want.items() if n > 1}


def test_a_life_is_given_once_when_it_is_over(spark, tmp_path, touches):
    from attestry.streaming import grouped

    rows, files = touches
    out = drain(spark, tmp_path, files, lambda s: grouped.lives(s, "6 hours"), "append", 1)
    want = []
    for key in [None, *range(30)]:
        for s in sorted(r[2] + 1_699_999_200 for r in rows if r[1] == key):
            if want and want[-1][0] == key and s < want[-1][2]:
                want[-1] = (key, want[-1][1], s + 6 * 3600, want[-1][3] + 1)
            else:
                want.append((key, s, s + 6 * 3600, 1))
    got = [(r.key, int(r.start.timestamp()), int(r.expires_at.timestamp()), r.n) for r in out if r.key != -1]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r["_batch"] for r in out}) > 2  # not all at the end


def test_a_part_of_a_stream_is_read_by_many_tasks(spark, monkeypatch):
    import glob

    from attestry import catalog

    monkeypatch.setattr(catalog, "FILE_ROWS", 50)
    _, path = catalog._stream(spark, "/root/testdata/sf0.001")
    n = [len(glob.glob(f"{path.removeprefix('file://')}/in/{i}/part-*")) for i in range(6)]
    assert n[0] > 1 and len(set(n[:5])) == 1 and n[5] <= n[0]
