"""Small cases with known answers."""

import datetime

from pyspark.sql import functions as F

from attestry.functions import dates
from attestry.operators import audits, corpus, facts, ledgers, pages, similarity


def test_dates_are_accepted_or_refused_with_a_reason(spark):
    cases = [
        ("2001-04-03", None, "2001-04-03", None), ("25/04/2001", None, "2001-04-25", None), ("04/25/2001", None, "2001-04-25", None),
        ("03/04/2001", None, None, "ambiguous"), ("03/04/2001", "DMY", "2001-04-03", None), ("03/04/2001", "MDY", "2001-03-04", None),
        ("2001-02-31", None, None, "impossible"), ("25/26/2001", None, None, "impossible"), ("", None, None, "blank"),
        ("sometime in 2001", None, None, "unknown format"), ("2000-02-29", None, "2000-02-29", None), ("1900-02-29", None, None, "impossible"),
        ("3 April 2001", None, "2001-04-03", None), ("April 3, 2001", None, "2001-04-03", None), ("3 Apr 2001", None, "2001-04-03", None), ("Marble 3, 2001", None, None, "unknown format"), ("31 Feb 2001", None, None, "impossible"),
        ("13-04-2001", None, "2001-04-13", None), ("2001/04/13", None, "2001-04-13", None), ("2001.4.3", None, "2001-04-03", None), ("4.3.2001", None, None, "ambiguous"), ("4.3.2001", "DMY", "2001-03-04", None),
        ("4-3-2001", "MDY", "2001-04-03", None), ("4/3/2001", "YMD", None, "ambiguous"), ("2001-13-01", None, None, "impossible"), ("2001-01-00", None, None, "impossible"), ("0099-1-2", None, "0099-01-02", None),
        (" 2001-04-03 ", None, "2001-04-03", None), ("3Apr2001", None, "2001-04-03", None), ("April 2001", None, None, "impossible"), ("Sept. 3, 2001", None, "2001-09-03", None), (None, None, None, "blank"), ("03/04/01", None, None, "unknown format"),
    ]
    df = spark.createDataFrame([("s", raw, hint) for raw, hint, _, _ in cases], "set_id string, raw string, order_hint string")
    got = {(r.raw, h): (r.date, r.reason) for r, (_, h, _, _) in zip(facts.date_audit(df).collect(), cases, strict=True)}
    assert got == {(raw, hint): (date, reason) for raw, hint, date, reason in cases}


def test_orders_are_stated_or_unknown(spark):
    cases = {"DD/MM/YYYY": "DMY", "mm-dd-yyyy": "MDY", "YYYY-MM-DD": "YMD", "your date of birth": "unknown", None: "unknown", "": "unknown"}
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", dates.date_order(F.col("h")).alias("o"))
    assert {r.h: r.o for r in df.collect()} == cases


def test_times_of_day(spark):
    cases = {
        "14:30": "14:30", "2:30 pm": "14:30", "12:05 AM": "00:05", "12:05pm": "12:05", "at 9:00, sharp": "09:00", "24:00": None, "23:60": None, "noon": None, "": None, None: None,
        "13:00 pm": "13:00", "7:15\nPM": "19:15", "99:99 1:00": None, "1:005": "01:00",
    }
    df = spark.createDataFrame([("s", t) for t in cases], "set_id string, raw string")
    assert {r.raw: r.time for r in facts.time_audit(df).collect()} == cases


def test_lenient_dates(spark):
    cases = {"born 2001-04-03": "2001-04-03", "3 April 01": "2001-04-03", "Apr 3, 1968": "1968-04-03", "3/4/68": "1968-04-03", "3.4.2001": "2001-04-03", "32 words": None, "3 Foo 2001": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", dates.lenient_date(F.col("t"), 2026).alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


def test_pacific_days(spark):
    cases = {"2026-03-10 05:30": "2026-03-09", "2026-03-10 08:30": "2026-03-10", "2026-07-15 06:30": "2026-07-14", "2026-12-15 07:30": "2026-12-14", "2026-12-15 08:30": "2026-12-15"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ledgers.pacific_day(F.col("t").cast("timestamp_ntz")).alias("d"))
    assert {r.t: str(r.d) for r in df.collect()} == cases


def test_limits_outlive_the_day_and_users_outrank(spark):
    d = lambda n: datetime.date(2026, 3, n)
    rows = [("a", d(1), 3, None, 20), ("a", d(2), 1, None, None), ("a", d(3), 1, 50, 10), ("b", d(1), 2, None, None)]
    out = ledgers.limit_carry_forward(spark.createDataFrame(rows, "key string, day date, used long, user_limit long, observed_limit long"))
    assert [(r.key, r["limit"], r.limit_source) for r in out.orderBy("key", "day").collect()] == [("a", 20, "observed"), ("a", 20, "observed"), ("a", 50, "user"), ("b", None, "unknown")]


def test_versions(spark):
    rows = [(1, "f", "2026-01-01 00:00:00", "answer"), (2, "f", "2026-01-01 00:00:01", "scan"), (3, "f", "2026-01-01 00:00:02", "answer"),
            (4, "f", "2026-01-01 00:00:03", "navigate"), (5, "f", "2026-01-01 00:00:04", "answer"), (6, "f", "2026-01-01 00:00:05", "remove"), (7, "f", "2026-01-01 00:00:06", "answer")]
    df = spark.createDataFrame(rows, "event_id long, key string, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.verdict for r in ledgers.version_check(df).orderBy("event_id").collect()] == ["gone", "current", "navigated", "gone"]


def test_keep_first_keeps_rows_without_key_and_is_idempotent(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "seq long, k string")
    kept, removed = corpus.dedupe_keep_first(items, F.col("k"), "seq")
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4, 5]
    assert [(r.seq, r.duplicate_of) for r in removed.collect()] == [(2, 1)]
    again, none = corpus.dedupe_keep_first(kept, F.col("k"), "seq")
    assert again.count() == 4 and none.count() == 0


def test_fingerprint_ignores_order_only(spark):
    schema = "set_id string, file_name string, text string"
    mark = lambda rows: corpus.set_fingerprint(spark.createDataFrame(rows, schema)).first().fingerprint
    assert mark([("s", "a", "x"), ("s", "b", "y")]) == mark([("s", "b", "y"), ("s", "A", "x")])
    assert mark([("s", "a", "x"), ("s", "b", "y")]) != mark([("s", "a", "x"), ("s", "b", "z")])


def test_fingerprints_of_parts_add_up(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(s, f"f{i}", f"t{i}") for s, n in (("a", 25), ("b", 1), (None, 7)) for i in range(n)] + [("c", None, "x"), ("d", None, "x"), ("d", "e", None), ("b", "f0", "t0")]
    schema = "set_id string, file_name string, text string"
    marks = corpus.set_fingerprint(spark.createDataFrame(rows, schema))
    entries = lambda s: [sha(f"{f}#{len(t or '')}:{sha(t or '')}") for i, f, t in rows if i == s and f is not None]
    added = lambda es: "".join(f"{sum(int(e[8 * i : 8 * i + 8], 16) for e in es) % 2**32:08x}" for i in range(8))
    want = {s: (sum(r[0] == s for r in rows), added(entries(s))) for s in ("a", "b", None, "c", "d")}
    assert {r.set_id: (r.n_files, r.fingerprint) for r in marks.collect()} == want
    halves = [corpus.set_fingerprint(spark.createDataFrame(rows[i::2], schema)) for i in (0, 1)]
    assert {r.set_id: (r.n_files, r.fingerprint) for r in corpus.merge_fingerprints(halves[0].unionByName(halves[1])).collect()} == want
    plan = marks._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "Sort" not in plan and "collect_list" not in plan


def test_rows_of_a_group_are_numbered_in_ranges(spark):
    rows = [(("a", "b", None)[i % 7 % 3], (i * 37) % 501) for i in range(501)] + [("c", None), ("c", 3), ("d", None)]
    out = corpus.numbered(spark.createDataFrame(rows, "g string, o long"), "g", "o", "n", pieces=5)
    order = lambda g: sorted((o for x, o in rows if x == g), key=lambda o: (o is not None, o or 0))
    want = {(g, o, i) for g in ("a", "b", "c", "d", None) for i, o in enumerate(order(g), 1)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == want
    assert "_piece" in out._jdf.queryExecution().toString()


def test_largest_files_are_limited_before_the_shuffle(spark):
    docs = spark.createDataFrame([("s", f"f{i}", "x" * i) for i in range(9)], "set_id string, file_name string, text string")
    plan = corpus.payload_budget(docs)
    assert plan.first().largest == "f8,f7,f6,f5,f4"
    assert "row_number(), 5, Partial" in plan._jdf.queryExecution().executedPlan().toString()


def test_values_are_grounded_by_every_rule(spark):
    docs = spark.createDataFrame([("s", "Jane Quinn, tel. +1 (555) 012-3456"), ("s", "Studied Biochemistry at Northfield"), ("s", None), ("e", " ")], "set_id string, text string")
    cases = {
        1: ("s", "jane  QUINN", True, []), 2: ("s", "15550123456", True, []), 3: ("s", "1-555-012-3457", False, ["3457"]),
        4: ("s", "chem", True, []), 5: ("s", "Quinn of the Northfield", True, []), 6: ("s", "yes", True, []), 7: ("s", " ?", False, []), 8: ("s", None, False, []),
        9: ("s", "aaa Jane bbb ccc ddd eee", False, ["aaa", "bbb", "ccc", "ddd"]), 10: ("e", "yes", False, []), 11: ("none", "Jane", False, ["jane"]),
    }
    claims = spark.createDataFrame([(k, s, v) for k, (s, v, _, _) in cases.items()], "claim_id long, set_id string, value string")
    got = {r.claim_id: (r.grounded, r.missing) for r in corpus.grounded_values(claims, docs).collect()}
    assert got == {k: (g, m) for k, (_, _, g, m) in cases.items()}


def test_marks_do_not_count_for_the_length_of_labels(spark):
    labels = spark.createDataFrame([(1, "b", "Age"), (2, "b", "Age:*?!...;;"), (3, "b", "Name")], "id long, block string, label string")
    assert [tuple(r) for r in similarity.fuzzy_pairs(labels, 0.6).collect()] == [(1, 2, 1.0)]


def test_states_and_provenance(spark):
    rows = [("f", 1, "from documents", "cv.pdf"), ("f", 2, "from documents", "my memory"), ("f", 3, "draft", None)]
    out = audits.provenance_audit(spark.createDataFrame(rows, "form_id string, q_idx int, state string, source string")).first()
    assert (out.n, out.violations) == (3, 1)


def test_url_patterns(spark):
    cases = [
        ("https://jobs.workday.com/x", "https://*.workday.com/*", True), ("https://workday.com:8080/", "https://*.workday.com", True), ("https://notworkday.com/", "https://*.workday.com/*", False), ("http://a.workday.com/", "https://*.workday.com/*", False),
        ("http://a.org/", "*://a.org/*", True), ("http://b.a.org/", "*://a.org/*", False), ("HTTP://A.org", "*://a.org/*", True), ("http://a.org/x/y?q", "*://*/x/*", True), ("http://a.org/xx", "*://*/x/*", False), ("http://a.org/a.b", "*://a.org/a.b", True),
        ("http://a.org/aXb", "*://a.org/a.b", False), ("http://a.org/a/b/c", "*://*.org/*/c", True), ("http://a.org/a/b/d", "*://*.org/*/c", False), ("http://a.org/", "<all_urls>", True), ("about:blank", "x", True), ("http://a.org/", "nonsense", False), ("http://a.org:1/", "http://a.org:2/*", True),
    ]
    for url, pattern, covered in cases:
        left = pages.url_coverage(spark.createDataFrame([(url,), (None,)], "url string"), spark.createDataFrame([(pattern,)], "pattern string")).collect()
        assert (not left) == covered, (url, pattern)


def test_results_of_superseded_runs_are_told_apart(spark):
    rows = [("r0", "j", 0, "result"), ("r1", "", 1, "start"), ("r1", "j", 2, "queued"), ("r1", "j", 3, "result"), ("r1", "j", 4, "running"), ("r1", "j", 5, "result"), ("r1", "j", 6, "result"), ("r1", "k", 7, "running"), ("r2", "", 8, "start"), ("r1", "k", 9, "result"), ("r2", "m", 10, "running"), ("r2", "m", 11, "cancelled"), ("r2", "m", 12, "result")]
    log = spark.createDataFrame([(i, "f", *r) for i, r in enumerate(rows)] + [(99, "g", "r1", "k", 9, "result")], "event_id long, form_id string, run_id string, job string, ts long, kind string")
    got = {r.event_id: r.outcome for r in ledgers.job_results(log).collect()}
    assert got == {0: "no run", 3: "not running", 5: "delivered", 6: "not running", 9: "superseded", 12: "not running", 99: "no run"}


def test_evidence_agrees_or_conflicts(spark):
    from attestry.operators import questions

    cases = {
        1: ([("a", "Jane Quinn"), ("b", "jane  quinn")], True, 2),
        2: ([("a", "+15550123456"), ("b", "+15550199999")], False, 2),
        3: ([("a", "Jane Quinn Doe"), ("b", "Jane Kquinn Doe")], False, 2),
        4: ([("a", "x")], True, 1),
        5: ([("a", "Quinn"), ("b", "Jane Quinn Doe"), ("c", "Jane Quinn")], True, 3),
    }
    rows = [(k, i, s, v) for k, (values, _, _) in cases.items() for i, (s, v) in enumerate(values)]
    out = questions.evidence_agreement(spark.createDataFrame(rows, "answer_id long, seq long, source string, value string")).collect()
    assert {r.answer_id: (r.agree, r.files) for r in out} == {k: (agree, files) for k, (_, agree, files) in cases.items()}
    assert next(r.value for r in out if r.answer_id == 5) == "Jane Quinn Doe"


def test_leaking_a_manual_question_fails(spark):
    import pytest

    from attestry.operators import questions

    q = spark.createDataFrame([(1, 1, True), (1, 2, False)], "form_id int, q_idx int, manual_only boolean")
    assert questions.boundary_leak_check(q.where("q_idx = 2").select("form_id", "q_idx"), q).count() == 1
    with pytest.raises(Exception, match="manual-only"):
        questions.boundary_leak_check(q.select("form_id", "q_idx"), q).collect()


def test_facts_of_one_set_replace_only_that_set(spark, tmp_path):
    from attestry.sources.facts import read_documents, write_facts

    make = lambda rows: spark.createDataFrame(rows, "set_id string, field string, value string")
    path = str(tmp_path / "facts")
    write_facts(make([("a", "email", "1"), ("b", "email", "2")]), path)
    write_facts(make([("a", "email", "3")]), path)
    assert sorted((r.set_id, r.value) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("b", "2")]
    (tmp_path / "docs" / "s1").mkdir(parents=True)
    (tmp_path / "docs" / "s1" / "x.txt").write_text("one\ntwo")
    assert [tuple(r) for r in read_documents(spark, str(tmp_path / "docs")).collect()] == [("s1", "x.txt", "one\ntwo")]
