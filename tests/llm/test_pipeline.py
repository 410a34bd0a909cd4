"""The pipeline against a brute-force version of its five stages, on a small folder of tables."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from test_operators import MULTI, brute_hits, jaccard, lower, shingles, spaced

import corpus_pipeline
from attestry.llm import bpe, toxicity
from attestry.llm.common import work_dir


@pytest.fixture(scope="module")
def folder(spark, bench):
    rng = np.random.default_rng(4)
    word = lambda: f"v{rng.integers(3000)}"
    texts = [" ".join(word() for _ in range(40)) + "\n" + " ".join(word() for _ in range(30)) for _ in range(60)]
    texts += [texts[3], texts[4].replace(" ", "  ", 1), texts[5] + "\n" + " ".join(word() for _ in range(40)), None, "", " \n"]
    rows = bench.collect()
    texts += [f"pre {rows[0].text} post {word()}", "one two"]
    toxic = [i % 6 == 0 for i in range(len(texts))]
    texts = [f"{t} vile {t.split()[0]}" if bad and t and t.strip() else t for t, bad in zip(texts, toxic, strict=True)]
    at = f"{work_dir(spark)}/folder-{rng.integers(1 << 60)}-{id(texts)}"
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bad)) for i, bad in enumerate(toxic) if i < 58], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    return at, docs, [(r.item_id, r.text) for r in rows]


def test_pipeline(spark, folder):
    at, docs, items = folder
    read = spark.read.parquet
    model = toxicity.train(read(f"{at}/documents.parquet"), read(f"{at}/labels.parquet"))
    scores = model.scores(toxicity.columns_of(pa.array([t for _, t, *_ in docs], pa.string())))
    kept = [(i, t) for (i, t, *_), s in zip(docs, scores, strict=True) if s < 0.7]
    assert 0 < len(docs) - len(kept) < len(docs)

    earlier, after = [], []
    for i, text in kept:
        lines = []
        for line in (text or "").split("\n"):
            s = frozenset(spaced(line))
            if not s or not any(s == o or jaccard(s, o) for o in earlier):
                lines.append(line)
            if s:
                earlier.append(s)
        if any(spaced(x) for x in lines):
            after.append((i, "\n".join(lines)))

    sets = {i: shingles(spaced(lower(t))) for i, t in after}
    up = {i: i for i, _ in after}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, _ in after:
        for j, _ in after:
            if i < j and jaccard(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    clean = [(i, t) for i, t in after if root(i) == i and not brute_hits(t, items)[4]]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(MULTI))}, special_tokens={})
    want = [(i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean]
    got = sorted((r.doc_id, r.token_ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect())
    assert got == sorted(want)


def test_stages_keep_columns_and_take_empty_input(spark, folder):
    at, *_ = folder
    none = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, at)
        assert out.count() == 0
        assert name == "byte_bpe" or out.columns == none.columns


def test_one_text_of_each_class_stays_when_ids_are_shared_or_null(spark):
    base = {x: [f"{x}{i}" for i in range(60)] for x in "abcde"}
    text = lambda x, at=None: " ".join("changed" if i == at else w for i, w in enumerate(base[x]))
    rows = [
        (1, text("a")), (5, text("a", 0)), (5, text("b")), (1, text("c")), (None, text("a", 59)),  # a: only that of 1 stays
        (7, text("d")), (7, text("d", 0)), (7, text("d").upper()), (None, text("e")), (None, text("e", 0)), (None, text("e")),
        (5, ""), (5, None), (1, " "), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_class(spark, docs, "").collect()]
    assert len(got) == len(set(got))
    of = lambda x: [(i, t) for i, t in got if t and f"{x}30" in t.lower()]
    assert of("a") == [(1, text("a"))] and of("b") == [(5, text("b"))] and of("c") == [(1, text("c"))]
    assert len(of("d")) == 1 and len(of("e")) == 1
    assert {(5, ""), (5, None), (1, " "), (None, "")} <= set(got)
