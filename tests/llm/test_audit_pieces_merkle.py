"""Filter audit, SentencePiece encoding and Merkle manifest against plain computations, the library and hand-made trees."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import filter_audit, merkle, piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def key(rows):
    return sorted(rows, key=str)


# Filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, part, text). One row for each part, order and step, filter by filter over lists of rows."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(f, i, t):
        w = words(t)
        if f == "E":
            return i is not None and i > least[t]
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}[f]

    good, toxic = ({i for i, *l in labels if i is not None and l[k] == 1} for k in (0, 1))
    out = []
    for part in {p for _, p, _ in docs}:
        rows = [(i, {f for f in "ABCDE" if fails(f, i, t)}) for i, p, t in docs if p == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                failing = sum(f in r[1] for r in rows)
                one = sum(r[1] == {f} for r in rows)
                steps.append((f, (part, "".join(order), k + 1, len(left), len(removed), failing - len(removed), one, sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed))))
        out += [(*row, shapley[f]) for f, row in steps]
    return out


def audit_rows(spark):
    many = " ".join(f"w{i}" for i in range(220))
    texts = [many, many, many.upper(), "few words", "few words", None, "", "the " * 300, many + " #", "A# A# A#", "é" * 50_000, "word " * 100_000]
    rows = [(i, ["en", "de", None, ""][i % 4], t) for i, t in enumerate(texts * 2)]
    rows += [(None, "en", many), (None, "en", "few words"), (3, "en", "few words"), (3, "en", "few words"), (7, "fr", many + "x")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, lang string, text string, part int, fails int"), rows


def test_audit(spark):
    docs, rows = audit_rows(spark)
    marked = [(0, 1, 0), (1, 0, 1), (1, 1, None), (3, 1, 1), (5, None, 1), (None, 1, 1), (9, 0, 0), (15, 1, 0), (77, 1, 1)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, filter_audit.RULES, labels)
    want = brute_audit([(i, p or "", t or "") for i, p, t in rows], marked)
    assert key([tuple(r) for r in got.collect()]) == key(want)


def test_audit_of_nothing_and_of_other_rules(spark):
    docs, rows = audit_rows(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), filter_audit.RULES, labels).count() == 0
    two = {"X": lambda text, words, n: n < 3, "Y": lambda text, words, n: F.length(text) > 100}
    got = filter_audit.audit(docs, two, labels).where("part = 'de'").orderBy("filter_order", "step").collect()
    texts = [t or "" for _, p, t in rows if p == "de"]
    x, y = [len(t.split()) < 3 for t in texts], [len(t) > 100 for t in texts]
    both = sum(a and b for a, b in zip(x, y, strict=True))
    assert [(r.filter_order, r.removed, r.redundant) for r in got] == [("XY", sum(x), 0), ("XY", sum(y) - both, both), ("YX", sum(y), 0), ("YX", sum(x) - both, both)]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, {"XX": two["X"]}, labels)


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return piece_bpe.PieceBpe(piece_bpe.read_model(MODEL), cached=50)


PARTS = [" ", "  ", "▁", "a", "b", "th", "e", "\n", "\t", "é", "é", "\x00", "你", "🎉", "ing", " the", " " * 17, "<s>", "<0x41>", "ﬁ", "xxxxxxx", " ", "﻿"]


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.one_of(st.sampled_from(PARTS), st.text(st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=40).map("".join))
def test_pieces_equal_the_library(text, own, library):
    ids = own.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids).decode() == library.decode(ids.tolist())


@settings(max_examples=400, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.sampled_from([0, 1, 2, 259, 28705])), max_size=9))
def test_any_ids_decode_as_in_the_library(ids, own, library):
    assert own.decode(np.array(ids, int)).decode() == library.decode(ids)


def test_long_words_and_many_texts(own, library):
    rnd = random.Random(3)
    letters = "".join(rnd.choice("abcdefghijklmnop") for _ in range(20_000))
    texts = ["", letters, "ab" * 50_000, " " * 1500, "你好" * 20_000, "a " * 50_000, *[letters[i : i + 9] for i in range(500)]]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)


def test_pieces_of_a_table(corpus, library, spark):
    got = piece_bpe.encode(corpus, MODEL)
    want = []
    for r in corpus.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        want.append((r.doc_id, len(ids), *sha, ids))
    assert key([tuple(r) for r in got.collect()]) == key(want)
    assert piece_bpe.encode(corpus.limit(0), MODEL).count() == 0
    assert "token_ids" not in piece_bpe.encode(corpus, MODEL, with_ids=False).columns


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.byte_fallback = False
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.read_model(str(tmp_path / "m"))


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests, fan_out):
    """(root, path of each) level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, p in enumerate(paths):
            start = at[k] - at[k] % fan_out
            p.append(("".join(digests[start : at[k]]), "".join(digests[at[k] + 1 : start + fan_out])))
            at[k] //= fan_out
        digests = [H(*digests[i : i + fan_out]) for i in range(0, len(digests), fan_out)]
    return digests[0], paths


def brute_manifest(rows, fan_out):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    trees, subroots, out = {}, [], []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots.append(brute_tree([leaf(r) for r in trees[lang]], fan_out))
    root, tops = brute_tree([s for s, _ in subroots], fan_out)
    for lang, (sub, paths), top in zip(order, subroots, tops, strict=True):
        for r, path in zip(trees[lang], paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            d = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if tampered else leaf(r)
            for a, b in path + top:
                d = H(a, d, b)
            out.append((r[0], leaf(r), sub, root, H(*(a + b for a, b in path + top)), d, d == root))
    return out


def held():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize(("fan_out", "levels", "sizes"), [(2, 2, (37, 1, 5)), (2, 8, (37, 1, 5)), (3, 1, (28, 9)), (2, 1, (1,)), (2, 3, (65,)), (4, 2, (17, 16, 1, 1, 1))])
def test_manifest(spark, fan_out, levels, sizes):
    rows = []
    for lang, n in zip([None, "", "de", "é", "zz"], sizes, strict=False):
        rows += [(1000 - 7 * len(rows) if i != 2 else None, "s" if i % 3 else None, lang, i * 11 if i % 5 else None, ["", None, "text é", "x" * 200_000][i % 4]) for i in range(n)]
    rows += rows[:2]  # repeated rows
    rows.append((rows[0][0], "other", rows[0][2], 5, "same doc_id"))
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string")
    got = merkle.manifest(docs, held=held(), fan_out=fan_out, levels=levels)
    found = got.collect()
    assert key([tuple(r)[:7] for r in found]) == key(brute_manifest(rows, fan_out))
    for r in found:
        assert merkle.fold(r.leaf, r.path) == r.root
        assert merkle.digest("".join(r.path)) == r.proof_sha256


def test_manifest_of_nothing_and_of_itself(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, "t") for i in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs.limit(0)).count() == 0
    assert merkle.manifest(docs, with_paths=False).where("verified").count() == 20
    by_source = merkle.manifest(docs, tree="source", columns=("doc_id", "text")).collect()
    assert len({r.root for r in by_source}) == 1
    assert all(r.subroot == r.root for r in by_source)  # one tree
