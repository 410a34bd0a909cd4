"""Facts of the sets that changed, and of no others."""

import pytest

from attestry.operators import corpus, reading
from attestry.plans.fact_pipeline import FactStore, set_facts
from attestry.work import written

SCHEMA = "set_id string, file_name string, text string"
CV = "Jane Quinn Doe\njane.quinn@example.com\n+44 20 7946 0000"
LETTER = "This letter is to certify that Jane Quinn Doe, ID No: UGR/1234/15 is an active 3rd Year student of Riverton University"
FORM = "Full Name: Computer Engineering\nNationality: Utopian\nDate of Birth: 4 March 2001"


@pytest.fixture
def store(spark, tmp_path):
    seen = {}

    def keep(df, label):
        seen.setdefault(label, []).append(df)
        return written(df, label)

    out = FactStore(spark, str(tmp_path / "store"), keep)
    out.seen = seen
    return out


def folder(spark, path, rows):
    """Documents in a table partitioned by set."""
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").partitionBy("set_id").parquet(str(path))
    return spark.read.schema("file_name string, text string, set_id string").parquet(str(path))


def facts_of(df):
    return {(r.set_id, r.field): (r.value, r.source, r.corroboration, r.confidence) for r in df.collect()}


def test_only_changed_sets_are_read(spark, store, tmp_path):
    rows = [("a", "cv.txt", CV), ("a", "letter.txt", LETTER), ("a", "form.txt", FORM), ("b", "cv.txt", CV), ("c", "note.txt", "nothing"), ("d", "x.txt", None)]
    docs = folder(spark, tmp_path / "one", rows)
    assert {r.set_id: r.verdict for r in store.refresh(docs, 1, "p").collect()} == dict.fromkeys("abcd", "nothing cached")
    first = facts_of(store.facts())
    assert first["a", "name"] == ("Jane Quinn Doe", "letter.txt", 2, "high")  # the label's "Computer Engineering" loses to what handles and files agree on
    assert first["a", "nationality"] == ("Utopian", "form.txt", 1, "high")
    assert first["a", "dob"] == ("2001-03-04", "form.txt", 1, "high")
    assert first["a", "education"] == ("Riverton University", "letter.txt", 1, "medium")
    assert ("c", "name") not in first

    again = folder(spark, tmp_path / "two", [*rows[:3], ("b", "cv.txt", CV + "\nwww.example.org"), *rows[4:5]])
    assert {r.set_id: r.verdict for r in store.refresh(again, 1, "p").collect()} == {"a": "reuse", "b": "files changed", "c": "reuse", "d": "removed"}
    read = store.seen["candidates"][-1]
    assert {r.set_id for r in read.select("set_id").distinct().collect()} == {"b"}
    plan = read._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(set_id" in x and "b)" in x for x in scans)  # other sets' files aren't opened
    now = facts_of(store.facts())
    assert now["b", "url"] == ("www.example.org", "cv.txt", 1, "high")
    assert {k: v for k, v in now.items() if k[0] == "a"} == {k: v for k, v in first.items() if k[0] == "a"}
    assert now == facts_of(set_facts(again, 2026, written))

    n = len(store.seen["candidates"])
    assert {r.verdict for r in store.refresh(again, 1, "p").collect()} == {"reuse"}
    assert len(store.seen["candidates"]) == n  # nothing to read
    assert {r.verdict for r in store.refresh(again, 2, "p").collect()} == {"version"}
    assert facts_of(store.facts()) == now


def test_manual_facts_outlive_runs(spark, store, tmp_path):
    docs = folder(spark, tmp_path / "docs", [("a", "cv.txt", CV), (None, "stray.txt", CV)])
    store.refresh(docs, 1, "p")
    manual = spark.createDataFrame([("a", "phone", "none", "manual", 1, "high"), ("z", "name", "Zed", "manual", 1, "high")], "set_id string, field string, value string, source string, corroboration long, confidence string")
    for version in (1, 2):
        store.refresh(docs, version, "p")
        got = facts_of(store.facts(manual))
        assert got["a", "phone"] == ("none", "manual", 1, "high") and got["z", "name"][0] == "Zed"
        assert got["a", "email"][0] == "jane.quinn@example.com"
        assert {k[0] for k in got} == {"a", "z"}


def test_a_store_without_documents_or_facts(spark, store):
    empty = spark.createDataFrame([], SCHEMA)
    assert store.refresh(empty, 1, "p").count() == 0
    assert store.manifest() is None
    store.refresh(spark.createDataFrame([("a", "x", "")], SCHEMA), 1, "p")
    assert store.facts().count() == 0
    assert store.manifest().count() == 1


def test_report_lists_every_file_in_order(spark):
    docs = spark.createDataFrame([("b", "z", FORM), ("a", "y", ""), ("a", "x", LETTER)], SCHEMA)
    got = [(r.set_id, r.file_name, r.note, r.n_facts, r.labelled, r.contextual, r.fields) for r in corpus.extraction_report(docs, reading.all_candidates(docs)).collect()]
    assert got == [("a", "x", "short", 4, 0, 4, "education,id,name,year_standing"), ("a", "y", "no text", 0, 0, 0, ""), ("b", "z", "short", 3, 3, 0, "dob,name,nationality")]
