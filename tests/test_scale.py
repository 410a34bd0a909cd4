"""Work is spread over tasks, done once, and no derived table passes the driver."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry import catalog, catalog_forms
from attestry.functions import text as tx
from attestry.operators import corpus, forms, ledgers, similarity
from attestry.sources import html
from attestry.streaming import in_order
from attestry.work import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("job", [forms.substantial_forms, forms.manual_only_flags, lambda f: forms.option_groups(forms.manual_only_flags(f))])
def test_pages_are_parsed_once_and_by_all_tasks(spark, job):
    pages = catalog_forms._pages(spark, SF)
    assert pages.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    logical, _ = plan(job(html.page_fields(pages)))
    assert logical.count("MapInPandas") == 1 and "Join" not in logical


def test_forms_of_pages_apart_and_together(spark):
    rows = [(p, s, f, t) for p, form in ((1, [(0, "text"), (0, "password"), (1, "text"), (None, "text")]), (2, [(0, "text"), (None, "password")])) for s, (f, t) in enumerate(form)]
    fields = spark.createDataFrame(rows, "page_id int, seq int, form int, type string").withColumns({c: F.lit(None).cast("string") for c in ("name", "label", "autocomplete")})
    assert sorted((r.page_id, r.seq) for r in forms.substantial_forms(fields).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    flags = {(r.page_id, r.seq): r.manual_reason for r in forms.manual_only_flags(fields).collect()}
    assert flags == {(1, 0): "part of a login form", (1, 1): "password field", (1, 2): None, (1, 3): None, (2, 0): None, (2, 1): "password field"}


@pytest.mark.parametrize("job", ["slot_placement", "profile_match", "attachment_match"])
def test_derived_sides_are_not_broadcast(spark, job):
    _, physical = plan(catalog.queries()[job](spark, SF))
    broadcast = [line for line in physical.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("tiles_" in line or "[block#" in line for line in broadcast), broadcast  # numbers of tiles are a row for each large block


def test_of_the_questions_only_the_defaults_are_broadcast(spark):
    _, physical = plan(catalog.queries()["resolve_questions"](spark, SF))
    assert physical.count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("job", ["option_choice", "option_choices", "all_candidates", "labelled_pairs", "profile_match"])
def test_few_bytes_of_much_work_are_spread(spark, job):
    logical, _ = plan(catalog.queries()[job](spark, SF))
    assert re.search(r"RepartitionByExpression \[[cp]_", logical)


def test_splice_stops_when_only_cycles_are_left(spark):
    """A chain of 40 nodes, a cycle with a tail: rounds follow the depth, not the number of nodes."""
    from attestry.operators import pages


    rows = [(i, i - 1 if i else None, 0) for i in range(40)] + [(100, 101, 0), (101, 100, 0), (102, 101, 0)] + [(1000 + i, None, 0) for i in range(3000)]
    kept = []
    out = {r.id: r for r in pages.hierarchy_splice(spark.createDataFrame(rows, "id long, parent long, ord long"), lambda df: kept.append(0) or written(df, "t")).collect()}
    assert len(out) == len(rows)
    assert [out[i].position for i in range(40)] == list(range(1, 41)) and out[39].root == 0 and out[39].depth == 39
    assert {i for i, r in out.items() if r.note == "cycle"} == {100, 101, 102}
    assert len(kept) <= 17


def test_fingerprint_of_a_set_is_the_digest_of_all_its_entries(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("a", i, f"text {i}") for i in range(3000)] + [("b", 1, None), ("b", 2, "x"), (None, 3, "y")]
    want = {s: sha("|".join(sorted(sha(f"{i}#{len(t or '')}:{sha(t or '')}") for x, i, t in rows if x == s))) for s in ("a", "b", None)}
    docs = spark.createDataFrame(rows, "set_id string, file_name long, text string").repartition(3)
    assert {r.set_id: r.fingerprint for r in corpus.digest_fingerprint(docs).collect()} == want


def test_streams_keep_state_by_groups_of_keys(spark):
    log = spark.readStream.schema("event_id long, key long, ts timestamp, kind string").parquet(f"{SF}/events.parquet")
    out = in_order.versions(log)
    assert "[group#" in out._jdf.queryExecution().analyzed().toString().split("TransformWithState")[1] and dict(out.dtypes)["key"] == "bigint"


def test_rate_of_a_busy_key_is_counted_without_a_sliding_frame(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.randrange(-3000, 9000) if i % 50 else None) for i in range(600)]
    log = spark.createDataFrame(rows, "event_id long, key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = ledgers.rolling_rate(log, rpm=4, window_ms=700)
    near = lambda k, m: [x for _, y, x in rows if y == k and (x is m if m is None or x is None else m - 700 <= x <= m)]
    for r in got.collect():
        _, key, ms = rows[r.event_id]
        seen = near(key, ms)
        wait = 0 if len(seen) <= 2 else 250 if ms is None else max(250, min(seen) + 700 - ms + 50)
        assert (r.key, r.in_window, r.over, r.wait_ms) == (key, len(seen), len(seen) > 2, wait)
    assert got.count() == len(rows)
    assert "RangeFrame" not in plan(got)[0]


def test_assignment_by_levels_makes_fewer_pairs_of_the_same_result(spark):
    rng, keep = random.Random(7), lambda df: written(df, "t")
    side = lambda: spark.createDataFrame([(i % 2, i, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))) for i in range(160)], "block int, id long, label string")
    left, right = keep(side()), keep(side())
    pairs = similarity.label_pairs(left, right, 0.55)
    want = sorted(tuple(r) for r in similarity.assign(pairs, keep).collect())
    rows = []
    assert sorted(tuple(r) for r in similarity.assign_labels(left, right, 0.55, lambda df: rows.append(df.count()) or keep(df)).collect()) == want
    assert max(rows) < pairs.count() / 2


def test_scripts_are_counted_by_all_tasks_and_most_of_a_text_once(spark):
    texts = [None, "", "abc déf", "Ā1 ɏɐ ÀÿABC", "שלום hello", "привет, мир", "日本 ひら x", "\x00\x7f\x80é", "𝒜b\n", "አማ ar العربية Ελ हिन्दी"]
    docs = spark.createDataFrame([(f"s{i % 4}", i, t) for i, t in enumerate(texts)], "set_id string, file_name long, text string").coalesce(1)
    got = tx.letters_by_script(docs, "text")
    want = docs.select("set_id", "file_name", *[tx.letters_of(F.coalesce("text", F.lit("")), p).alias(code) for code, p in tx.SCRIPTS])
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    logical, _ = plan(corpus.language_by_script(docs))
    assert "RepartitionByExpression [file_name" in logical


def test_texts_of_asked_sets_are_normalised_once_after_they_are_spread(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(corpus, "written", lambda df, label: kept.append(df) or written(df, label))
    docs = spark.createDataFrame([("a", 1, "Jane Quinn, 55-01 23"), ("a", 2, None), ("b", 3, "nothing"), ("c", 4, " ,")], "set_id string, file_name long, text string")
    claims = spark.createDataFrame([(1, "a", "quinn JANE"), (2, "a", "5501-23"), (3, "b", "Jane"), (4, "c", "Jane"), (5, "d", "x"), (6, "a", " ")], "claim_id long, set_id string, value string")
    got = {r.claim_id: (r.grounded, r.missing) for r in corpus.grounded_values(claims, docs).collect()}
    assert got == {1: (True, []), 2: (True, []), 3: (False, ["jane"]), 4: (False, ["jane"]), 5: (False, []), 6: (False, [])}
    logical, _ = plan(kept[0])
    assert len(kept) == 1 and "regexp_replace" in logical.split("RepartitionByExpression")[0] and "regexp_replace" not in logical.split("RepartitionByExpression")[1]


def test_fingerprints_are_the_sqls_where_names_or_texts_are_missing(spark, tmp_path):
    rows = [("unnamed", None, "x"), ("unnamed", None, "y"), ("mixed", None, "x"), ("mixed", 5, None), ("mixed", 6, ""), (None, 7, "z"), (None, None, None), ("twice", 3, "s"), ("twice", 3, "s")]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = catalog.JOBS["set_fingerprint"]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select set_id, n_files, fingerprint from ({sql})").fetchall()}
    assert want["unnamed"] == (2, None) and len(want) == 4
    assert {r.set_id: (r.n_files, r.fingerprint) for r in query(spark, str(tmp_path)).collect()} == want
