"""Options, assignment and refusal: equal keys first, and never one side twice."""

import itertools

import pytest

from attestry.operators import forms, ledgers, matching, questions, similarity


@pytest.fixture
def keep():
    return lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def tidy(x):
    return x.strip().lower().rstrip("*?!.,:;").strip()


def alike(x, y):
    x, y = tidy(x), tidy(y)
    return round(1 - lev(x, y) / max(len(x), len(y)), 6) if x and y else 0


def noisy_labels():
    import random

    rng = random.Random(4)
    base = ["date of birth", "place of birth", "full name", "employer", "phone number", "ab", "a", "expected graduation", "naïve café 42", "", " * "]
    return base + ["".join(c if rng.random() > 0.25 else rng.choice("abcdef é5") for c in b) for b in base for _ in range(4)]


@pytest.mark.parametrize("tile", [1000, 5])
def test_label_pairs_find_every_similar_pair(spark, tile):
    labels = noisy_labels()
    left, right = [(1, i, x) for i, x in enumerate(labels) if i % 2], [(1, i, x) for i, x in enumerate(labels) if not i % 2] + [(2, 0, "employer"), (None, 5, "employer")]
    schema = "block long, id long, label string"
    for least in (0.55, 0.8, 1.0):
        got = sorted((r.a, r.b, r.score) for r in similarity.label_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), least, tile=tile).collect())
        assert got == sorted((i, j, alike(x, y)) for (p, i, x), (q, j, y) in itertools.product(left, right) if p == q and alike(x, y) >= least)


@pytest.mark.parametrize("tile", [1000, 5])
def test_pairs_of_one_table_are_given_once(spark, tile):
    labels = list(enumerate(noisy_labels() + ["Employer:", "employer"]))
    got = [(r.a, r.b, r.score) for r in similarity.fuzzy_pairs(spark.createDataFrame([(i, 1, x) for i, x in labels], "id long, block long, label string"), 0.6, tile=tile).collect()]
    assert sorted(got) == [(i, j, alike(x, y)) for (i, x), (j, y) in itertools.combinations(labels, 2) if alike(x, y) >= 0.6]


@pytest.mark.parametrize("block_pairs", [100, 0])
def test_assignment_is_greedy_and_uses_no_side_twice(spark, keep, block_pairs):
    import random

    rng = random.Random(7)
    pairs = [(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.6), (1, 3, 2, 0.7), (2, 1, 1, 0.5), (2, 2, 1, 0.5)]
    pairs += [(3, a, b, rng.choice([0.6, 0.7, 0.8])) for a in range(9) for b in range(9) if rng.random() < 0.6]
    got = sorted((r.block, r.a, r.b) for r in similarity.assign(spark.createDataFrame(pairs, "block long, a long, b long, score double"), keep, block_pairs).collect())
    left, want = sorted(pairs, key=lambda p: (-p[3], p[1], p[2])), []
    for block, a, b, _ in left:
        if not any(block == x and (a == y or b == z) for x, y, z in want):
            want.append((block, a, b))
    assert got == sorted(want)


def test_options_of_a_set_by_equality_words_and_similarity(spark):
    import random
    import re

    rng = random.Random(5)
    words = "electrical computer engineering science of and arts civil law a bc".split()
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bend = lambda x: x.replace("e", "3", 1) if rng.random() < 0.4 else x.upper() + "!"
    options = [(s, i, phrase(rng.randint(1, 4))) for s in (1, 2) for i in range(25)] + [(1, 99, "--"), (1, 98, "")]
    values = [(i, 1 + i % 2, bend(rng.choice(options)[2]) if i % 3 else phrase(rng.randint(1, 5))) for i in range(60)] + [(100, 1, " "), (101, 1, None), (102, 7, "law")]
    plain = lambda x: re.sub(r"[\W_]+", " ", (x or "").lower()).strip()
    want = {}
    for i, s, value in values:
        v, best = plain(value), None
        for t, pos, option in options:
            o = plain(option)
            if s != t or not v or not o:
                continue
            inside = min(len(v), len(o)) >= 3 and (f" {o} " in f" {v} " or f" {v} " in f" {o} ")
            tier = 1 if v == o else 2 if inside else 3 if alike(v, o) >= 0.8 else None
            if tier:
                best = min(best or (9,), (tier, -alike(v, o), pos, option))
        want[i] = best and (best[3], best[0])
    got = questions.option_resolve(spark.createDataFrame(values, "id long, set_id long, value string"), spark.createDataFrame(options, "set_id long, pos long, option string"))
    assert {r.id: r.option and (r.option, r.tier) for r in got.collect()} == want
    assert len({x[1] for x in want.values() if x}) == 3


def test_identity_refuses_on_doubt(spark, keep):
    q = spark.createDataFrame([("f", 1, "Employer", "k1"), ("f", 2, "Employer", "k2"), ("g", 1, "Hobby", None)], "form_id string, q_id long, label string, identity_key string")
    a = lambda rows: spark.createDataFrame(rows, "form_id string, a_id long, label string, value string, identity_key string, invalidated boolean")
    got = lambda rows: sorted((r.form_id, r.a_id, r.q_id, r.how) for r in matching.identity_match(q, a(rows), keep).collect())
    assert got([("f", 7, "Employer", "Acme", "k2", False)]) == [("f", 7, 2, "key")]
    assert got([("f", 7, "Employer", "Acme", None, True)]) == [("f", 7, None, "refused")]
    assert got([("g", 7, "Employer", "Acme", None, True), ("g", 8, "Zzz", "x", None, False)]) == [("g", 7, None, "refused"), ("g", 8, None, "none")]


@pytest.mark.parametrize(("value", "options", "want"), [
    ("4th Year", ["1 Year", "4+ Years"], "4+ Years"), ("JavaScript", ["Java", "JS"], "JS"), ("JavaScript", ["Java"], None), ("Electrical and Computer Engineering", ["CE", "ECE"], "ECE"),
    ("Master of Science (MSc)", ["Bachelor", "Master of Science"], "Master of Science"), ("Femal", ["Male", "Female"], "Female"), ("", ["A"], None), ("yes", [], None),
])
def test_options(spark, value, options, want):
    row = spark.createDataFrame([(1, value, options)], "id long, value string, options array<string>")
    assert matching.option_choice(row).first().chosen == want


def test_quota_windows(spark):
    rows = [("per minute FreeTier", None), ("GenerateRequestsPerDay-FreeTier", None), ("free_tier", 30_000), ("free_tier", None), ("slow down", None), (None, None)]
    df = spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(rows)], "id long, body string, retry_ms long")
    assert [r.window for r in ledgers.quota_window_class(df).orderBy("id").collect()] == ["per_minute", "daily", "per_minute", "daily", "per_minute", "per_minute"]
    limits = [('{"violations":[{"quotaValue":"20"}]}', 20), ("{}", None), ('{"violations":[{"quotaValue":"0"}]}', None)]
    df = spark.createDataFrame([(i, b, None) for i, (b, _) in enumerate(limits)], "id long, body string, retry_ms long")
    assert [r.observed_limit for r in ledgers.quota_window_class(df).orderBy("id").collect()] == [n for _, n in limits]


def test_frames_of_one_source_are_ambiguous_unless_they_know_their_slot(spark):
    frames = "page_id long, frame_id long, parent_frame_id long, url string, self_slot int, scanned boolean"
    slots = "page_id long, frame_id long, slot_idx int, src string, ord int"
    s = spark.createDataFrame([(1, 0, 0, "https://a.org/x", 1), (1, 0, 1, "https://a.org/x", 2)], slots)
    both = [(1, 0, -1, "https://a.org", None, True), (1, 1, 0, "https://a.org/x", 1, True), (1, 2, 0, "https://a.org/x", None, True)]
    got = {r.frame_id: (r.method, r.slot_idx, r.ord) for r in forms.slot_placement(spark.createDataFrame(both, frames), s).collect()}
    assert got == {0: ("root", None, None), 1: ("frame-element", 1, 2), 2: ("ambiguous", None, None)}


def test_letters_are_counted_in_larger_blocks_only(spark, monkeypatch):
    """Counting costs more than a few distances do; pairs are the same with and without."""
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(b, b * 10 + i, x) for b in range(3) for i, x in enumerate(["Date of birth", "Date of birht", "Employer", "Name"])], "block long, id long, label string")
    many = spark.createDataFrame([(9, i, f"label number {i}") for i in range(similarity.FEW + 4)], "block long, id long, label string")
    pairs = lambda x: sorted(tuple(r) for r in similarity.label_pairs(x, x, 0.8).collect())
    want = pairs(few.unionByName(many))
    monkeypatch.setattr(similarity, "FEW", 0)
    assert pairs(few.unionByName(many)) == want
    monkeypatch.setattr(similarity, "FEW", 16)
    refused = lambda _: [F.raise_error(F.lit("letters were counted")).cast("long")] * 2
    monkeypatch.setattr(similarity, "letter_marks", refused)
    assert pairs(few) == [p for p in want if p[0] < 3] and len(pairs(few)) == 18
