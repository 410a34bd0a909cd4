"""Evidence that says one thing in two spellings, and values that a set's texts hold in parts."""

import random

import pytest

from attestry.operators import corpus, questions

ECE, FULL, OTHER = "ECE", "Electrical and Computer Engineering", "Electronics and Communication Engineering"
LINKS = f"Studied {FULL} (ECE) in town"


@pytest.mark.parametrize(("evidence", "text", "agree", "value"), [
    ([("a.pdf", ECE), ("b.pdf", FULL)], LINKS, True, FULL),
    ([("a.pdf", FULL), ("b.pdf", "ece")], "ECE is short for " + FULL.upper(), True, FULL),
    ([("a.pdf", ECE), ("b.pdf", OTHER)], LINKS, False, None),  # the same initials, not linked
    ([("a.pdf", ECE), ("b.pdf", FULL)], "", False, None),
    ([("a.pdf", ECE), ("b.pdf", FULL)], f"{FULL} is a piece of work", False, None),  # "ece" within a word
    ([("a.pdf", ECE), ("b.pdf", FULL)], f"{FULL}{'.' * 77}ECE", True, FULL),
    ([("a.pdf", ECE), ("b.pdf", FULL)], f"{FULL}{'.' * 78}ECE", False, None),  # outside of the window
    ([("a.pdf", ECE), ("a.pdf", FULL)], "", True, FULL),  # one file says it in two ways
    ([("a.pdf", ECE), ("a.pdf", FULL), ("b.pdf", OTHER)], LINKS, False, None),
    ([("a.pdf", "  Electrical and   Computer Engineering "), ("b.pdf", FULL.lower())], "", True, "  Electrical and   Computer Engineering "),
    ([("a.pdf", "Riverton University"), ("b.pdf", "Riverton University - RU")], "", True, "Riverton University - RU"),
    ([("a.pdf", "+15550123456"), ("b.pdf", "+15550199999")], "", False, None),
    ([("a.pdf", " "), ("b.pdf", FULL)], "", True, FULL),
])
def test_agreement(spark, evidence, text, agree, value):
    rows = spark.createDataFrame([(1, 7, i, *e) for i, e in enumerate(evidence)] + [(2, 8, 0, "a.pdf", ECE), (2, 8, 1, "b.pdf", FULL)], "answer_id long, set_id long, seq long, source string, value string")
    docs = spark.createDataFrame([(7, "x", text), (7, "y", None), (8, "x", "nothing"), (9, "x", LINKS)], "set_id long, file_name string, text string")
    got = {r.answer_id: r for r in questions.evidence_agreement(rows, questions.acronym_links(rows, docs)).collect()}
    assert (got[1].agree, got[1].value) == (agree, value)
    assert not got[2].agree  # another set's text links nothing


def test_contained_equals_a_scan(spark):
    rng = random.Random(2)
    text = lambda a, b: "".join(rng.choice("abcé") for _ in range(rng.randint(a, b)))
    wholes = [(s, text(0, 30)) for s in (1, 2) for _ in range(20)] + [(1, "a" * 50_000 + "zzz")]
    parts = [(s, text(0, 6)) for s in (1, 2, 3) for _ in range(80)] + [(1, "azz"), (1, "zzz"), (2, "zzz"), (None, "abc")]
    got = corpus.contained(spark.createDataFrame(parts, "set_id long, part string"), spark.createDataFrame(wholes, "set_id long, whole string"), 3)
    want = {(s, p) for s, p in parts if len(p) >= 3 and any(t == s and p in w for t, w in wholes)}
    assert {(r.set_id, r.part) for r in got.collect()} == want and len(want) > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Join Inner, (set_id") == 0  # nothing meets by its set alone


def test_links_of_a_set_of_any_size_meet_by_rare_words(spark, monkeypatch):
    from attestry.operators import questions as q

    rows, files = [], []
    for i in range(40):
        a, b = chr(97 + i % 20), chr(97 + i // 20)
        rows += [(i, 0, "a.pdf", 1, f"o{a}{b}".upper()), (i, 0, "b.pdf", 2, f"Office of {a}xd {b}elta")]
        files += [(0, 10 * i + j, f"office of x and y; o{a}{b}: Office of {a}xd {b}elta" if i % 3 and not j else f"office of {a}xd") for j in range(5)]
    evidence = spark.createDataFrame(rows, "answer_id long, set_id long, source string, seq long, value string")
    docs = spark.createDataFrame(files, "set_id long, file_name long, text string")
    seen = []
    monkeypatch.setattr(q, "written", lambda df, label: seen.append((label, df.count())) or df)
    for side in (q.counted_side, q.sorted_side):  # broadcast or not
        monkeypatch.setattr(q, "counted_side", side)
        got = {r.answer_id for r in q.acronym_links(evidence, docs).collect()}
        assert got == {i for i in range(40) if i % 3}
    assert dict(seen)["rare"] <= 40
    agreed = {r.answer_id: (r.agree, r.files) for r in q.evidence_agreement(evidence, q.acronym_links(evidence, docs)).collect()}
    assert all(agreed[i] == (i in got, 2) for i in range(40))
    plan = q.evidence_agreement(evidence)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Aggregate") == 1  # sources are not counted by another grouping
