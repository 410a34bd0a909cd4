"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
import time
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import attribution, bpe, chat, decontaminate, elias_fano, hashing, line_dedup, partenum, pii, quality, token_file, toxicity
from attestry.llm.common import work_dir

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(words, k=5):
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b) and bool(a)


def docs_of(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=str)


# Decontamination


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for number, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        if number is None or not iw:
            continue
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(number))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_contamination(corpus, bench, rows):
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = key([(i, *brute_hits(t, items)) for i, t in docs_of(corpus)])
    assert key([tuple(r) for r in decontaminate.contamination(corpus, bench, broadcast_rows=rows).collect()]) == want


def test_decontaminate_keeps_columns_and_clean_rows(corpus, bench):
    kept = decontaminate.decontaminate(corpus, bench)
    assert kept.columns == corpus.columns
    assert key([r.doc_id for r in kept.collect()]) == key([None, 1, 2, 3, 4, 4, 7, 8, 9, 12, 13, 14, 15])


def test_contamination_of_empty_tables(corpus, bench):
    assert decontaminate.contamination(corpus.limit(0), bench).count() == 0
    assert decontaminate.contamination(corpus, bench.limit(0)).where("contaminated").count() == 0


# N-gram Jaccard join


@pytest.mark.parametrize("rows", [10**6, 0])
def test_near_classes(corpus, rows):
    docs = docs_of(corpus)
    sets = [shingles(spaced(lower(t))) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if jaccard(sets[i], sets[j]):
            up[root(j)] = root(i)
    want = []
    for i, (number, _) in enumerate(docs):
        members = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        want.append((number, len(sets[i]), min(members, default=None) if sets[i] else number))
    got = partenum.near_classes(corpus, broadcast_rows=rows).select("doc_id", "n_shingles", "component_id")
    assert key([tuple(r) for r in got.collect()]) == key(want)


def test_near_classes_of_nothing(corpus):
    assert partenum.near_classes(corpus.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 260), st.integers(0, 60))
def test_similar_sets_share_a_signature(seed, size, edits):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    drop = rng.integers(0, min(edits, len(a)) + 1)
    b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, edits - min(edits, drop), dtype=np.uint64))))
    common = len(np.intersect1d(a, b))
    if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
        assert len(np.intersect1d(partenum.signatures(a, 80), partenum.signatures(b, 80)))


def test_parities_bound_differences():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (90, 70))
    apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in partenum.parities(a) ^ partenum.parities(b))
    assert apart <= len(np.setxor1d(a, b))


def test_word_hashes_do_not_depend_on_batches():
    texts = ["", None, "a", "A  b\tc d e f", "q" * 600_000 + " r s t u v w", "é è\nx y z"]
    together = list(hashing.shingle_sets(pa.array(texts, pa.string()), 5))
    for t, s in zip(texts, together, strict=True):
        assert list(hashing.shingle_sets(pa.array([t], pa.string()), 5))[0].tolist() == s.tolist()
        assert len(s) == len(shingles(spaced(lower(t))))


def test_a_step_of_the_fit_takes_little_memory_beyond_the_problem():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 20_000, 300).astype(np.int32)) for _ in range(1000)]
    problem = toxicity.Problem(rows, np.arange(1000) % 2, [(rows[0][:2], rows[1][:1]), (rows[2][:1], rows[3][:0])], 1.0)
    w, bias = rng.normal(size=len(problem.used)), 0.3
    problem.slope(w, bias)
    tracemalloc.start()
    value, slope, bias_slope = problem.slope(w, bias)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(problem.flat)
    sums = np.bincount(problem.of, w[problem.flat] * problem.sign, problem.n + problem.m)
    p = 1 / (1 + np.exp(-np.clip(sums[: problem.n] + bias, -40, 40)))
    pull = np.concatenate((problem.balance * (p - problem.y), 2 * sums[problem.n :] / problem.m))
    assert np.array_equal(slope, np.bincount(problem.flat, pull[problem.of] * problem.sign, len(problem.used)))
    assert bias_slope == pull[: problem.n].sum()


# Line dedup


def test_line_dedup(corpus, spark):
    docs = docs_of(corpus)
    extra = [(20, "alpha " + " ".join(f"x{i}" for i in range(40))), (21, "beta " + " ".join(f"x{i}" for i in range(40)) + "\nfree words")]
    for n in range(10, 41, 3):  # one word of a line changed
        words = [f"y{n}-{i}" for i in range(n)]
        extra += [(100 + n, "\n".join((" ".join(words), f"own {n}", " ".join([*words[: n // 2], "changed", *words[n // 2 + 1 :]]))))]
    both = corpus.select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string").selectExpr("doc_id", "text", "length(text) as n_chars"))
    lines = []
    for number, text in dict.fromkeys(docs + extra):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if spaced(line):
                lines.append(((number is not None, number or 0, i), text, frozenset(spaced(line))))
    gone = {(at[1] if at[0] else None, t, at[2]) for at, t, s in lines if any(o < at and (s == r or jaccard(s, r)) for o, _, r in lines)}
    want = []
    for number, text in docs + extra:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (number, text, i) not in gone)
        want.append((number, kept))
    out = line_dedup.dedup_lines(both)
    assert out.columns == both.columns
    assert key([(r.doc_id, r.text) for r in out.collect()]) == key(want)
    assert gone
    assert line_dedup.dedup_lines(both.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1, 3])
@pytest.mark.parametrize("rows", [10**6, 0])
def test_line_dedup_of_words_and_shingles(spark, words, rows):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"u{x}" for x in rng.permutation(14)[: rng.integers(8, 13)]) for _ in range(60)]
    lines += ["one two three four", "two one four three", "a b a", "b a", "a", "a b c d", "a b c d e", "e d c b a f"]
    lines += [" ".join(f"z{x}" for x in np.sort(rng.permutation(44)[:40])) for _ in range(40)]
    lines += [" ".join(f"q{x}" for x in range(a, a + 30)) for a in (0, 2, 4, 90, 91)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [frozenset(spaced(x)) if words == 1 else shingles(spaced(x), words) for x in lines]
    want = {i for i, s in enumerate(sets) if any(jaccard(s, o) for o in sets[:i])}
    assert want
    assert {r.doc_id for r in line_dedup.decisions(docs, shingle_words=words, broadcast_rows=rows).collect()} == want


def test_similar_lines_share_neighbours():
    """For all sizes and sets that differ as much as they may: neighbours shared within both prefixes."""
    rng = np.random.default_rng(3)
    for percent in (70, 80, 90):
        for na in range(2, 40):
            for nb in range(na, na * 100 // percent + 1):
                o = -(-(na + nb) * percent // (100 + percent))
                if 100 * o < percent * (na + nb - o) or o > na or na == nb == o:
                    continue
                for _ in range(8):
                    order = rng.permutation(na + nb - o)
                    common, a, b = order[:o], order[o:na], order[na:]
                    x, y = np.sort(np.concatenate((common, a))), np.sort(np.concatenate((common, b)))
                    pairs = [set(zip(s, s[1:], strict=False)) for s in (x[: len(x) * (200 - 2 * percent) // 100 + 2].tolist(), y[: len(y) * (200 - 2 * percent) // 100 + 2].tolist())]
                    assert pairs[0] & pairs[1], (percent, na, nb)


def test_similar_lines_share_three_neighbours_or_are_small():
    """For all sizes and sets that differ as much as they may, or less."""
    rng = np.random.default_rng(4)
    for percent in (70, 80, 90):
        few, met = line_dedup.small_sets(percent), 0
        for na in range(1, 45):
            for nb in range(na, na * 100 // percent + 1):
                for o in range(-(-(na + nb) * percent // (100 + percent)), na + 1):
                    if na == nb == o:
                        continue
                    assert na * (100 - percent) >= percent  # smaller sets have no keys
                    for _ in range(4):
                        order = rng.permutation(na + nb - o)
                        x, y = np.sort(order[:na]).tolist(), np.sort(np.concatenate((order[:o], order[na:]))).tolist()
                        runs = [{tuple(s[i : i + k]) for i in range(min(len(s), len(s) * k * (100 - percent) // 100 + k) - k + 1)} for s in (x, y) for k in (2, 3)]
                        assert runs[1] & runs[3] or (nb <= few and runs[0] & runs[2]), (percent, na, nb, o)
                        met += not runs[1] & runs[3]
        assert bool(met) == bool(few)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_line_dedup_of_lines_of_any_size(spark, percent):
    """Among lines of 1 to 40 words of a small vocabulary, with copies that lack or gain some words."""
    rng, lines = np.random.default_rng(percent), []
    for n in range(1, 41):
        for _ in range(3):
            words = rng.permutation(60)[:n].tolist()
            lines.append(words)
            for less, more in ((1, 0), (0, 1), (1, 1), (2, 1), (0, 3), (4, 0)):
                lines.append(rng.permutation([*words[min(less, n - 1) :], *(100 + rng.permutation(20)[:more])]).tolist())
    sets = [frozenset(x) for x in lines]
    want = {i for i, s in enumerate(sets) if any(100 * len(s & o) >= percent * len(s | o) for o in sets[:i])}
    docs = spark.createDataFrame([(i, " ".join(f"v{w}" for w in x)) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.decisions(docs, percent=percent).collect()} == want


def test_lines_that_share_two_neighbours_only_do_not_meet(spark):
    """Keys of many unlike lines that have two words in common, next to each other, and of two similar ones."""
    sets = spark.createDataFrame([(i, 20, [0, 1, *range(100 * i, 100 * i + 13)]) for i in range(1, 9)] + [(9, 20, [7, 8, 9, *range(900, 912)]), (10, 20, [6, 7, 8, 9, *range(1000, 1011)])], "sid long, n int, prefix array<int>")
    shared = line_dedup._with_keys(sets, 80).groupBy("key").agg(F.sort_array(F.collect_list("sid")).alias("of")).where("size(of) > 1").collect()
    assert [r.of for r in shared] == [[9, 10]]
    small = spark.createDataFrame([(1, 3, [1, 2, 3]), (2, 4, [1, 2, 3, 4]), (3, 5, [1, 2, 9, 3, 4]), (4, 5, [1, 2, 3, 8, 9])], "sid long, n int, prefix array<int>")
    assert {r.sid for r in line_dedup._with_keys(small, 80).where(f"p = {line_dedup.MAX_PLACE}").collect()} == {2, 3, 4}


def test_rank_table_keeps_the_most_frequent_of_a_slot():
    rng = np.random.default_rng(9)
    hashes = [int(x) for x in rng.integers(-(2**63), 2**63, line_dedup.RANKED, dtype=np.int64)]
    table, bits = line_dedup.rank_table(hashes), line_dedup._RANK_BITS
    for slot, entry in enumerate(table):
        ranks = [r for r, h in enumerate(hashes, 1) if h & (len(table) - 1) == slot]
        assert entry & ((1 << bits) - 1) == max(ranks, default=0)
        assert not ranks or entry >> bits == hashes[ranks[-1] - 1] >> bits


def test_line_dedup_keeps_columns_of_any_name_and_very_long_texts(spark):
    long = "\n".join(f"row {i} of {i * i}" for i in range(20000))
    docs = spark.createDataFrame([(1, long, 5), (2, long, 6), (3, None, 7)], "doc_id long, text string, x long").selectExpr("*", "x as gone", "x as d", "x as t", "x as kept")
    out = line_dedup.dedup_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and got[2].text == "" and got[1].text == long and got[3].text is None
    assert [got[2][c] for c in ("gone", "d", "t", "kept")] == [6] * 4


# Quality


def test_quality_base_counts(corpus):
    got = {}
    for r in quality.judge(corpus).collect():
        got.setdefault(r.doc_id, r)
    for number, text in docs_of(corpus):
        words = spaced(text or "")
        lines = [x for x in (text or "").split("\n") if spaced(x)]
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(wins)
        twice = {w for w, n in times.items() if n > 1}
        hit = {j for i, w in enumerate(wins) if w in twice for j in range(i, i + 3)}
        r = got[number]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit)), number
        assert r.base_failed == (len(words) < 50 or 2 * len(hit) > len(words))
        assert not (r.base_failed and r.kept)
    assert quality.judge(corpus.limit(0)).count() == 0


def brute_quality(rows, prior=50):
    """(kept or not) of rows (lang, source, text), by sorted lists in place of sketches."""

    def bucket(v):
        shift = max(v.bit_length() - 8, 0)
        return v >> shift << shift

    told = []
    for lang, source, text in rows:
        words, lines = spaced(text or ""), [x for x in (text or "").split("\n") if spaced(x)]
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w, n in Counter(wins).items() if n > 1}
        hit = len({j for i, w in enumerate(wins) if w in twice for j in range(i, i + 3)})
        chars, marks = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
        share = lambda a, b, unit: a * unit // b if b else 0
        metrics = (share(chars, len(words), 1000), share(marks, chars, 10000), share(len(lines) - len(set(lines)), len(lines), 10000), share(hit, len(words), 10000))
        told.append((lang or "", source or "", len(words) < 50 or 2 * hit > len(words), metrics))
    good = [t for t in told if not t[2]]
    out = []
    for lang, source, bad, metrics in told:
        kept = not bad
        for m, slack in enumerate((500, 200, 6000, 3000)):
            near, own = ([bucket(t[3][m]) for t in good if t[0] == lang and (wide or t[1] == source)] for wide in (True, False))
            if not own:
                kept = False
                break
            share = lambda b: (sum(x <= b for x in own) * len(near) + prior * sum(x <= b for x in near), (len(own) + prior) * len(near))  # noqa: E731, B023
            quart = lambda q: next(b for b in sorted(set(near)) if 4 * share(b)[0] >= q * share(b)[1])  # noqa: E731, B023
            q1, q3 = quart(1), quart(3)
            kept = kept and metrics[m] <= q3 + 3 * (q3 - q1) + slack and (m > 0 or metrics[m] >= q1 - 3 * (q3 - q1) - slack)
        out.append(kept)
    return out


def test_quality_thresholds(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(90):
        size = int(rng.integers(3, 9))
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, size + 2))) for _ in range(rng.integers(40, 120))]
        if i % 7 == 0:
            words = [w + "#" * int(rng.integers(0, 4)) for w in words]
        text = " ".join(words)
        if i % 5 == 0:
            text += ("\n" + " ".join(words[:4])) * int(rng.integers(1, 9))
        rows.append((["en", "de", None][i % 3], ["a", "b", None, "tiny"][0 if i % 4 else i % 3] if i % 11 else "tiny", text))
    rows += [("en", "a", None), ("en", "a", ""), ("fr", "only", " ".join(f"w{i}" for i in range(60)))] + [rows[0]] * 2
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").selectExpr("*", "1 as word_len", "2 as repeats")
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    want = brute_quality(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert 0 < sum(want) < len(want)
    bare = {r.doc_id: r.kept for r in quality.judge(docs.drop("lang", "source")).collect()}
    assert [bare[i] for i in range(len(rows))] == brute_quality([(None, None, t) for *_, t in rows])


# Tokens


def test_bpe_equals_the_library_and_decodes(corpus):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(MULTI))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = key([tuple(r) for r in bpe.encode(corpus, MULTI, public_tokenizers.PATTERN).collect()])
    want = []
    for number, text in docs_of(corpus):
        ids = library.encode_ordinary(text or "")
        want.append((number, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == key(want)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(bpe.read_ranks(MULTI), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t'sé9.,　日<|>\x1c", max_size=80))
def test_bpe_on_any_text(encoder, text):
    ranks = {t: i for i, t in enumerate(encoder.tokens)}
    library = test_bpe_on_any_text.__dict__.setdefault("library", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    ids = np.frombuffer(encoder.encode([text])[0], "<u4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_of_long_pieces(encoder):
    for text in ("a" * 3000, "ab" * 700 + "é" * 300, "=" * 999):
        assert encoder.decode(np.frombuffer(encoder.encode([text])[0], "<u4")) == text.encode()


@pytest.mark.parametrize("as_text", [False, True])
def test_token_file_round_trip(spark, corpus, as_text):
    path = f"{work_dir(spark)}/round-trip-{np.random.default_rng().integers(1 << 60)}"
    named = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x  <|endoftext|>\ty <|endoftext", "<|endoftext|><|endoftext|> ."]
    both = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    token_file.write(both, named, path, partitions=3, marks_as_text=as_text)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.checksums(token_file.read(spark, path)).collect()]
    token_file.write(both, named, path + "-whole", partitions=3, marks_as_text=as_text, whole=True)
    assert key(got) == key([tuple(r) for r in token_file.checksums(token_file.read(spark, path + "-whole")).collect()])
    tokenizer = Tokenizer.from_file(named)
    if as_text:
        tokenizer.encode_special_tokens = True
    want, start, all_ids = [], 0, []
    for number, text in sorted(docs_of(both), key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((number, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        all_ids.append(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert key(got) == key(want)
    segments = {(r.part, r.seq): r.n_docs for r in spark.read.parquet(path).select("part", "seq", "n_docs").collect()}
    places = [(*at, n) for at, count in sorted(segments.items()) for n in range(count)] + [(0, 0, 10**6), (99, 0, 0)]
    one = sorted(token_file.documents_at(spark, path, places).collect(), key=lambda r: (r.part, r.seq, r.nth))
    assert [r.doc_id for r in one] == [w[0] for w in want] and sorted(bytes(r.token_ids) for r in one) == sorted(all_ids)


def test_token_file_encodes_lone_chunks_as_one_text(monkeypatch):
    """The library gets new chunks by the thousand, not one by one; odd ones apart; ids are those of whole texts."""
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        blob = f.read()
    real, apart = tokenizers.Tokenizer.from_str(blob), []

    class Counted:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode(self, some, **kw):
            apart.extend(some)
            return real.encode(some, **kw)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_str": staticmethod(lambda _: Counted())}))
    monkeypatch.setattr(token_file, "_made", {})
    texts = [
        "a b c the.\nThe <|endoftext|> x<|endoftext|>y don't (it's) 日本語 🎉 é\x00 \u0120a \u0120", " lead  two\n \nlines end ", "", " ", "one", "x \x1c y\x1f z\u00a0 w \u2003v", "12 34,5 $$$ a$$$ \t b",
        " ".join(f"w{i}q{i * 7}" for i in range(20_000)),
    ]
    got = token_file._encoder(blob, "<u2", False)(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(apart) < 100 and not any(c.startswith(" w1") for c in apart)


def test_full_cache_of_chunks_keeps_those_at_hand():
    from attestry.llm.pieces import Encoder

    asked = []

    def encode(some):
        asked.extend(some)
        return [c.encode() for c in some]

    encoder = Encoder(encode, limit=30)
    for i in range(40):
        text = "head " + " ".join([*(f"often{j}" for j in range(20)), *(f"x{i}y{j}" for j in range(5))])
        assert encoder([text]) == [text.encode()]
        assert len(encoder.spaced) <= 30
    assert asked.count(" often7") == 1


def test_token_file_of_nothing(spark, corpus):
    path = f"{work_dir(spark)}/nothing-{np.random.default_rng().integers(1 << 60)}"
    token_file.write(corpus.limit(0), public_tokenizers.path("byte_bpe_50k.json"), path)
    assert token_file.read(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=700))
def test_elias_fano(values):
    values.sort()
    seq = elias_fano.Sequence(elias_fano.pack(np.array(values, np.uint64)))
    assert seq.all().tolist() == values
    assert all(seq.select(i) == values[i] for i in range(0, len(values), 37))


def test_attribution_counts_every_token_once(corpus):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(ranks))}, special_tokens={})
    rows = attribution.attribute(corpus, ranks, public_tokenizers.PATTERN).collect()
    want = {}
    for number, text in docs_of(corpus):
        want[number] = want.get(number, 0) + len(library.encode_ordinary(text or ""))
    got = dict.fromkeys(want, 0)
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == want


def brute_attribution(text, sections, encode):
    """Every token's characters counted one by one against every section."""
    places, at, data = [], 0, text.encode()
    owner_of = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
    for piece in encode(text):
        hit = owner_of[at : at + len(piece)]
        places.append((hit[0], hit[-1] + 1) if hit else (0, 0))
        at += len(piece)
    assert at == len(data)
    counts, crossing = {}, {}
    for a, b in places:
        shared = [len(set(range(a, b)) & set(range(x, y))) for x, y in sections]
        best = max(range(len(sections)), key=lambda i: (shared[i], -i), default=None)
        own = best if best is not None and shared[best] else None
        counts[own] = counts.get(own, 0) + 1
        crossing[own] = crossing.get(own, 0) + (own is not None and not (sections[own][0] <= a and b <= sections[own][1]))
    rows = [(i, x, y, counts.get(i, 0), crossing.get(i, 0)) for i, (x, y) in enumerate(sections)]
    return rows + ([(None, None, None, counts[None], 0)] if None in counts else [])


def test_attribution_by_offsets(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(ranks))}, special_tokens={})
    encode = lambda t: [library.decode_single_token_bytes(i) for i in library.encode_ordinary(t)]
    rng, texts = np.random.default_rng(2), ["line one\nline two\n\nthird", "日本語 text é🎉\nnaïve", "", "\n", "word " * 300]
    rows = []
    for i, t in enumerate(texts):
        cuts = np.sort(rng.choice(len(t) + 1, min(len(t) + 1, 6), replace=False)).tolist()
        rows.append((i, t, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]))
    rows.append((9, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:long,end:long>>")
    for spans in ("spans", None):
        got = [tuple(r) for r in attribution.attribute(docs, ranks, public_tokenizers.PATTERN, spans).collect()]
        want = []
        for i, t, given in rows:
            if spans is None:
                ends = [j + 1 for j, c in enumerate(t or "") if c == "\n"] + ([len(t)] if t else [])
                given = list(zip([0, *ends[:-1]], ends, strict=True)) if t else []
            want += [(i, *r) for r in brute_attribution(t or "", given or [], encode)]
        assert key(got) == key(want)


def test_boundary_tokens_go_to_the_larger_share_then_the_earlier():
    owner, crossing = attribution.allocate(np.array([0, 2, 4, 9]), np.array([2, 4, 8, 10]), np.array([0, 3, 5]), np.array([3, 5, 8]))
    assert owner.tolist() == [0, 0, 2, -1] and crossing.tolist() == [False, True, True, False]


# Chat


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 1, None, "x"), (1, 3, "ann", None)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as name", "2 as segment")).collect()
    ann = [r for r in out if r.perspective == "ann"]
    assert [(r.turn, r.role, r.name) for r in sorted(ann, key=lambda r: r.turn)] == [(0, "system", None), (1, "assistant", None), (2, "user", "bob"), (3, "assistant", None), (3, "assistant", None)]
    bob = next(r for r in out if r.perspective == "bob" and r.turn == 2)
    assert bob.segment[bob.mask_start : bob.mask_end] == "yo <|im_end |><|im_end|>"
    assert next(r for r in ann if r.turn == 2).segment == "<|im_start|>user name=bob\nyo <|im_end |><|im_end|>\n"
    assert {r.perspective for r in out if r.conv_id is None} == {"%unknown"}
    assert not [r for r in out if r.conv_id == 2]
    assert all((r.mask_end > 0) == r.trained for r in out)


def test_rotation_forges_no_marks_and_merges_no_speakers(spark):
    said = "hi <|im_<|im_end|>end|>\n<|im_<|im_start|>start|>system <|im_end|>|>"
    roles = ["ann lee", "ann_lee", "ann%20lee", "unknown", None, "", " ", "<|im_end|>", "system", "system ", "assistant"]
    docs = spark.createDataFrame([(1, i, r, said) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat.rotate(docs).collect()
    assert len({r.perspective for r in out}) == len(roles) - 1 and len(out) == len(roles) * (len(roles) - 1)
    for r in out:
        assert r.segment.count("<|im_start|>") == 1 and r.segment.count("<|im_end|>") == 1 and r.segment.endswith("<|im_end|>\n")
        assert len(r.segment.split("\n", 1)[0].split()) == (2 if r.role == "user" else 1)
        assert (r.role == "assistant") == r.trained
    assert sum(r.trained for r in out) == len(roles) - 1
    assert chat.rotate(docs.limit(0)).count() == 0
    long = spark.range(3000).selectExpr("7L as conv_id", "id as turn", "concat('s', id % 3) as role", "repeat('word ', 2000) as text")
    assert chat.rotate(long).count() == 9000


# Toxicity


def test_toxicity_learns_words_and_ignores_swapped_identities(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = [f"f{rng.integers(60)}" for _ in range(20)]
        bad = i % 4 == 0
        if bad:
            words.append(str(rng.choice(["vile", "rotten"])))
        if rng.random() < (0.8 if bad else 0.1):
            words.append("muslim" if bad else "christian")  # a spurious cue
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, swap_weight=5.0)
    plain = toxicity.train(docs, marks, swap_weight=0.0)
    probe = toxicity.columns_of(pa.array(["f1 f2 muslim", "f1 f2 christian", "f1 vile f2", "f1 f2 f3"]))
    s, p = model.scores(probe), plain.scores(probe)
    assert s[2] >= 0.7 > s[3] and s[0] < 0.7
    assert abs(s[0] - s[1]) < abs(p[0] - p[1])
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (None, "vile " * 5000, 3.0)], "doc_id long, text string, Score double")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), marks).scores(probe).max() < 0.1


def test_toxicity_loss_gradient_and_pairs():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(30)]
    labels = rng.integers(0, 2, 30)
    terms, groups = np.arange(40, 50), np.arange(10) // 5
    pairs = [p for r in rows for p in (toxicity.swaps(r, terms, groups, rng), toxicity.insertion(r, terms, groups, rng)) if p is not None]
    problem = toxicity.Problem(rows, labels, pairs, 3.0)
    w, bias = rng.normal(size=len(problem.used)), 0.3
    value, slope, bias_slope = problem.slope(w, bias)
    full = np.zeros(50)
    full[problem.used] = w
    logit = [full[r].sum() + bias for r in rows]
    each = [-np.log(1 / (1 + np.exp(-x if y else x))) * 0.5 / (labels == y).sum() for x, y in zip(logit, labels, strict=True)]
    brute = sum(each) + 3.0 * np.mean([(full[a].sum() - full[b].sum()) ** 2 for a, b in pairs])
    assert abs(value - brute) < 1e-9
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((problem.slope(up, bias)[0] - problem.slope(down, bias)[0]) / 2e-5 - slope[i]) < 1e-6
    assert abs((problem.slope(w, bias + 1e-5)[0] - problem.slope(w, bias - 1e-5)[0]) / 2e-5 - bias_slope) < 1e-6


def test_penalty_lowers_false_positives_on_neutral_mentions():
    """Terms are named in half of the toxic texts and few clean ones; clean texts that name a group must not be hit."""
    rng = np.random.default_rng(6)
    words = [columns[0] for columns in toxicity.columns_of(pa.array([f"g{i}" for i in range(300)]))]
    terms, _ = toxicity._term_columns(toxicity.TERM_ROWS)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        row = [*rng.choice(words[20:], 15), *(rng.choice(words[:3], 1) if bad and rng.random() < 0.8 else [])]
        if rng.random() < (0.7 if bad else 0.05):
            row.append(rng.choice(terms))
        rows.append(np.unique(row))
        labels.append(int(bad))
    labels = np.array(labels)
    fair, plain = toxicity.fit(rows, labels, swap_weight=5.0), toxicity.fit(rows, labels, swap_weight=0.0)
    assert fair.swapped > 100 and fair.inserted > 1000
    clean = [r for r, y in zip(rows, labels, strict=True) if not y and not np.isin(r, terms).any()][:200]
    assert toxicity.false_positives(fair, clean) < 0.5 * toxicity.false_positives(plain, clean)
    with pytest.warns(UserWarning, match="no counterfactual pairs"):
        toxicity.fit(rows, labels, terms=[])


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@+-( )_é%x\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def all_segmentations(n):
    if n == 0:
        yield []
    for k in range(1, n + 1):
        for rest in all_segmentations(n - k):
            yield [*rest, k]


def test_decoding_equals_enumeration():
    """Over all segmentations and labels of short runs; blocks of few tokens give what one block gives."""
    rng = np.random.default_rng(5)
    model = pii.SemiCrf(rng.normal(size=(5, pii.N_FEATURES)), rng.normal(size=(5, pii.BUCKETS)))
    for run in ("a@b.c", "+1 (2) 3", "1.2.3.4", "x-9 8", "4.4"):
        near = [3, 7]
        bounds, features, mask = pii.segments(run)
        scores = model.scores(features, mask, near)
        n, best = len(bounds) - 1, -1e18
        for lengths in all_segmentations(n):
            end = total = 0
            for k in lengths:
                end += k
                total += scores[end - 1, k - 1].max()
            best = max(best, total)
        got, value, at = model.decode(run, near), 0.0, 0
        spans = {bounds.index(a): (bounds.index(b), kind) for kind, a, b in got}
        while at < n:
            to, kind = spans.get(at, (at + 1, None))
            value += scores[to - 1, to - at - 1, 0 if kind is None else 1 + pii.KINDS.index(kind)]
            at = to
        assert abs(value - best) < 1e-9
    text = " ".join(f"{i}@x{i}.y +{i}" for i in range(60))
    whole, held = model.decode(text), pii.BLOCK
    try:
        pii.BLOCK = 7
        assert model.decode(text) == whole
    finally:
        pii.BLOCK = held


def test_gradient_of_the_field():
    rng = np.random.default_rng(6)
    model = pii.SemiCrf(rng.normal(size=(5, pii.N_FEATURES)) * 0.1)
    run, gold, near = "call +1 (2) 34", [("phone", 5, 14)], [4]

    def likelihood():
        bounds, features, mask = pii.segments(run)
        s = model.scores(features, mask, near)
        totals = []
        for lengths in all_segmentations(len(bounds) - 1):
            end = total = 0
            for k in lengths:
                end += k
                total += np.logaddexp.reduce(s[end - 1, k - 1])
            totals.append(total)
        i, j = bounds.index(5), bounds.index(14)
        return s[:i, 0, 0].sum() + s[j - 1, j - i - 1, 4] - np.logaddexp.reduce(totals)

    grad, pull = model._gradient(*pii.segments(run), gold, near)
    for place in ((0, 0), (4, 7), (4, 29), (2, 0)):
        model.w[place] += 1e-5
        up = likelihood()
        model.w[place] -= 2e-5
        assert abs((up - likelihood()) / 2e-5 - grad[place]) < 1e-3
        model.w[place] += 1e-5
    model.near[4, 4] += 1e-5
    up = likelihood()
    model.near[4, 4] -= 2e-5
    assert abs((up - likelihood()) / 2e-5 - pull[4]) < 1e-3


def test_field_tells_announced_numbers_from_counted_ones():
    model = pii.SemiCrf()
    model.w[0, 0] = 2.0
    model.fit(pii.templates(500, 1))
    held = pii.templates(300, 99)
    got = [(gold, model.decode(run, near)) for run, gold, near in held]
    found = sum(bool(g) and d == g for g, d in got)
    assert found >= 0.9 * sum(bool(g) for g, _ in got)
    assert sum(bool(d) and not g for g, d in got) <= 0.05 * len(got)


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "1", "a1" * 100_000, "1 " * 100_000, "@" * 200_000, ("x" * 50_000 + "@" + "y" * 50_000) * 5, "+1 " * 100_000])
def test_very_long_words_and_runs_take_linear_time(text):
    began = time.perf_counter()
    pii.find(text, pii.SemiCrf())
    assert time.perf_counter() - began < 30


def test_field_finds_unseen_spans_and_keeps_base_ones(spark):
    texts = [f"word call +1 (9{i:02d}) 555-{1000 + i} or mail me{i}@site{i}.example.com from 10.0.{i}.7 now {i} items" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(docs)
    base, spans = pii.find("ring (912) 555-4321 soon, or x@y.example.org", model)
    assert base == [("email", 29, 44)] and set(base) <= set(spans)
    assert ("phone", 5, 19) in spans
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1" * 20000), (4, texts[0]), (4, texts[0]), (None, "a@" * 5000)], "doc_id long, text string").selectExpr("*", "1 as spans")
    rows = pii.scan(odd, model).collect()
    assert len(rows) == 6 and [r.n_phone for r in rows] == [0, 0, 0, 1, 1, 0]
    assert pii.scan(odd.limit(0), model).count() == 0
    assert pii.find("count 912 555 4321 items", pii.train(docs.limit(0)))[0] == []


def test_byte_bpe_keeps_its_caches_small_and_strings_by_runs(monkeypatch):
    import pyarrow as pa
    import public_tokenizers

    from attestry.llm import bpe

    column = pa.array(["ab", None, "", "é" * 40, "x" * 9, None, "yz"] * 3).slice(1)
    runs = list(bpe.text_runs(column, 10))
    assert [t for _, _, texts in runs for t in texts] == column.to_pylist()
    assert [lo for lo, _, _ in runs] == [0, *[hi for _, hi, _ in runs][:-1]] and runs[-1][1] == len(column) and len(runs) > 3
    assert list(bpe.text_runs(column.slice(0, 0))) == []
    assert bpe.CHUNKS <= 120_000 and bpe.PIECES <= 60_000  # two workers of an executor hold them beside its heap
    texts = [" ".join(f"w{i}{j}é," for j in range(30)) for i in range(30)]
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = bpe.Bpe(tokens, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "CHUNKS", 40)
    monkeypatch.setattr(bpe, "PIECES", 25)
    small = bpe.Bpe(tokens, public_tokenizers.PATTERN)
    assert [x for t in texts for x in small.encode([t])] == want and len(small.texts.spaced) <= 40 + 61
