"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds whole spans.

The field scores candidate segments of up to MAX tokens by features of the whole span (shape, digit count,
separators, checksum, what stands around) and of the words before its run, and picks boundaries and kinds together with
a dynamic program over segments; tokens outside are segments of one token with the kind O. Only runs of words with a
digit or an at sign are decoded: other tokens have no entity features. It is trained here, by gradient steps on the
conditional likelihood: on runs of at most `sample` documents (the documented bound) with the spans of the patterns,
which teach boundaries and what is no entity, and on labelled template sentences in four languages, which the
patterns can't label: phone numbers without a country prefix after words that announce a call, against numbers of the
same shapes after words that count. Pattern spans always stay; segments that overlap none of them are added.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import batches_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns (email: see _emails). The lookbehind only skips starts that can't match.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MAX = 24  # tokens of an entity
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, at sign and dotted domain; each run is read once."""
    at = text.find("@")
    floor = 0
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Pattern spans by start, then kind; matches that fail their check are dropped and not tried again."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for kind in KINDS[1:]:
        for m in PATTERNS[kind].finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and luhn(digits)
            else:
                good = 10 <= len(digits) <= 15
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_WORD = re.compile(r"\S+")
_HOLDS = re.compile("[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CLASSES = "@.-+() "
N_FEATURES = 40
#: Tokens whose segments are scored at once: memory doesn't follow the length of a run.
BLOCK = 2048
#: Buckets of hashed words before a run, and how many of them count.
BUCKETS, NEAR = 512, 3


def runs(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of runs of words with a digit or an at sign, one space between them, in one line. Each word is read once."""
    if not _HOLDS.search(text):
        return
    start = end = -1
    for m in _WORD.finditer(text):
        if not _HOLDS.search(m[0]):
            continue
        if start >= 0 and m.start() == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if start >= 0:
            yield start, text[start:end]
        start, end = m.span()
    if start >= 0:
        yield start, text[start:end]


def before(text: str, at: int) -> list[int]:
    """Buckets of the last NEAR words (letters, lower case) before a place, in its line, within 60 characters."""
    line = text[max(at - 60, text.rfind("\n", max(at - 60, 0), at) + 1) : at].lower()
    return [zlib.crc32(w.encode()) % BUCKETS for w in re.findall(r"[^\W\d_]{2,}", line)[-NEAR:]]


def blocks(run: str) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """(first, bounds, features, mask) for every BLOCK ends: segments that end at tokens first, first + 1, ...

    Each block reads the MAX tokens before it and the one after, so the features are those of the whole run.
    """
    tokens = _TOKEN.findall(run)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).tolist()
    for first in range(0, len(tokens), BLOCK):
        lo, hi = max(0, first - MAX - 1), min(len(tokens), first + BLOCK)
        _, features, mask = segments(tokens[lo : hi + 1])
        yield first, bounds, features[first - lo : hi - lo], mask[first - lo : hi - lo]


def segments(run: str | list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(token bounds, features[end, length - 1], mask of segments that would start before the run)."""
    tokens = _TOKEN.findall(run) if isinstance(run, str) else run
    n = len(tokens)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    kind = np.array([9 if t[0].isascii() and t[0].isdigit() else 8 if t[0].isascii() and t[0].isalpha() else _CLASSES.find(t[0]) if t[0] in _CLASSES else 7 for t in tokens])
    counts = np.zeros((n + 1, 10), np.int64)
    counts[1:] = np.cumsum(kind[:, None] == np.arange(10), 0)
    digits = np.concatenate(([0], np.cumsum([len(t) if k == 9 else 0 for t, k in zip(tokens, kind, strict=True)])))
    small = np.concatenate(([0], np.cumsum([k == 9 and len(t) <= 3 and int(t) <= 255 for t, k in zip(tokens, kind, strict=True)])))
    end = np.repeat(np.arange(1, n + 1)[:, None], MAX, 1)
    start = end - np.arange(1, MAX + 1)[None, :]
    valid = start >= 0
    start = np.maximum(start, 0)
    c, d, s = counts[end] - counts[start], digits[end] - digits[start], small[end] - small[start]
    first, last = kind[start], kind[end - 1]
    before = np.where(start > 0, kind[np.maximum(start - 1, 0)], 6)
    after = np.where(end < n, kind[np.minimum(end, n - 1)], 6)
    at, dot, dash, plus, opened, closed, space, other, letters, numbers = (c[..., i] for i in range(10))
    plain = (at == 0) & (other == 0) & (letters == 0)
    checked = np.zeros(valid.shape, bool)
    for e, k in zip(*np.nonzero(valid & plain & (d >= 14) & (d <= 19) & (plus + opened + closed + dot == 0) & (first == 9) & (last == 9)), strict=True):
        checked[e, k] = luhn("".join(t for t in tokens[start[e, k] : end[e, k]] if t.isdigit()))
    edge = (before >= 6) & (before <= 7) & ((after == 6) | (after == 7) | (after == 1))
    word = (before == 8) | (before == 9) | (after == 8) | (after == 9)
    f = [
        np.ones(valid.shape, bool), at == 1, at > 1, (at == 1) & (dot > 0), (at == 1) & (space == 0), (at == 1) & ((first == 8) | (first == 9)), (at == 1) & ((last == 8) | (last == 9)),
        plain, first == 3, (first == 3) & plain, last == 9, first == 9, first == 4, letters > 0, other > 0, space > 0,
        d < 7, (d >= 7) & (d < 10), (d >= 10) & (d <= 13), (d >= 14) & (d <= 19), d > 19,
        (numbers == 4) & (s == 4) & (dot == 3) & (at + dash + plus + opened + closed + space + other + letters == 0) & (first == 9) & (last == 9),
        checked, edge, word, opened == closed, (opened == 1) & (closed == 1) & plain & (last == 9), dot > 3, plus > 1, dash > 0,
        (first == 3) & plain & (last == 9) & (d >= 10) & (d <= 15), (before == 3), first == 6, last == 6, last == 1, numbers == 0,
        (at == 1) & (dot > 0) & (space + other + opened + closed == 0) & ((last == 8) | (last == 9)) & ~word & (before != 1) & (before != 2),
        (opened == 1) & (closed == 1) & plain & (first == 4) & (last == 9) & (d == 10) & ~word & (before != 3), (after == 2) | (after == 1), checked & ~word,
    ]
    features = np.stack(f, -1).astype(np.float32)
    features[~valid] = 0
    return bounds.tolist(), features, np.where(valid, 0.0, -1e30)


class SemiCrf:
    """Weights: one row for O (single tokens), one for each kind."""

    def __init__(self, weights: np.ndarray | None = None, near: np.ndarray | None = None):
        self.w = np.zeros((1 + len(KINDS), N_FEATURES)) if weights is None else weights
        self.near = np.zeros((1 + len(KINDS), BUCKETS)) if near is None else near

    def scores(self, features: np.ndarray, mask: np.ndarray, near: list[int] = ()) -> np.ndarray:
        """[end, length - 1, label]; O has length 1 only. near: buckets of the words before the run."""
        s = features @ self.w.T + mask[..., None]
        if near:
            s[:, :, 1:] += self.near[1:, near].sum(1)
        s[:, 1:, 0] = -1e30
        return s

    def decode(self, run: str, near: list[int] = ()) -> list[Span]:
        """The best segmentation's entities, in the run's characters; of equal ones the shorter last segment, then the first
        label. Memory beyond the tokens is that of a block."""
        n, best_label, back, bounds = 0, [], [], [0]
        total = np.full(MAX, -1e30)
        total[-1] = 0.0  # the best up to each of the last MAX tokens
        for _, bounds, features, mask in blocks(run):
            s = self.scores(features, mask, near)
            label, best = s.argmax(2), s.max(2)
            for e in range(len(best)):
                there = best[e] + total[::-1]
                k = int(there.argmax())
                back.append(k)
                best_label.append(int(label[e, k]))
                total[:-1] = total[1:]
                total[-1] = there[k]
            total -= total[-1]  # only differences count
            n += len(best)
        out, e = [], n - 1
        while e >= 0:
            k, label = back[e], best_label[e]
            if label:
                out.append((KINDS[label - 1], bounds[e - k], bounds[e + 1]))
            e -= k + 1
        return out[::-1]

    def _gradient(self, bounds: list[int], features: np.ndarray, mask: np.ndarray, gold: list[Span], near: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the gold segmentation, by the features and by the words before."""
        s = self.scores(features, mask, near)
        n = len(s)
        each = np.logaddexp.reduce(s, axis=2)
        ahead, behind = np.full(n + MAX, -1e30), np.full(n + MAX, -1e30)
        ahead[MAX - 1] = 0.0
        for e in range(n):
            ahead[MAX + e] = np.logaddexp.reduce(each[e] + ahead[e : e + MAX][::-1])
        behind[n - 1] = 0.0  # behind[e]: from after token e
        for b in range(n - 1, 0, -1):
            ends = np.arange(b, min(n, b + MAX))
            behind[b - 1] = np.logaddexp.reduce(each[ends, ends - b] + behind[ends])
        before = np.stack([ahead[e : e + MAX][::-1] for e in range(n)])
        p = np.exp(np.clip(s + (before + behind[:n, None] - ahead[MAX + n - 1])[..., None], -700, 0))
        grad = -np.einsum("ekl,ekf->lf", p, features)
        pull = -p.sum((0, 1))
        place, covered = {b: i for i, b in enumerate(bounds)}, np.zeros(n, bool)
        for kind, a, b in gold:
            i, j = place[a], place[b]
            grad[1 + KINDS.index(kind)] += features[j - 1, j - i - 1]
            pull[1 + KINDS.index(kind)] += 1
            covered[i:j] = True
        grad[0] += features[~covered, 0].sum(0)
        return grad, pull

    def fit(self, examples: list[tuple[str, list[Span], list[int]]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-3, seed: int = 3) -> SemiCrf:
        """AdaGrad on examples (run, spans, words before); spans off token bounds or longer than MAX tokens are left out."""
        ready = []
        for run, gold, near in examples:
            bounds, features, mask = segments(run)
            place = {b: i for i, b in enumerate(bounds)}
            if all(a in place and b in place and place[b] - place[a] <= MAX for _, a, b in gold):
                ready.append((bounds, features, mask, gold, near))
        seen, seen_near, rng = np.full_like(self.w, 1e-2), np.full_like(self.near, 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(ready)):
                g, pull = self._gradient(*ready[i])
                g -= l2 * self.w
                seen += g * g
                self.w += rate * g / np.sqrt(seen)
                for x in ready[i][4]:
                    h = pull[1:] - l2 * self.near[1:, x]
                    seen_near[1:, x] += h * h
                    self.near[1:, x] += rate * h / np.sqrt(seen_near[1:, x])
        return self


# Words that announce a number to call, and words before numbers that are nobody's.
CALLS = "call phone tel telephone mobile ring fax whatsapp telefon handy anrufen rufen rückruf téléphone appeler portable joindre teléfono llamar móvil".split()
COUNTS = "order invoice page room version year item total bestellung rechnung seite zimmer jahr artikel commande facture page chambre année pedido factura página habitación año".split()
#: Shapes of phone numbers without a country prefix: no pattern finds them. d is a digit.
LOCAL_PHONES = ("ddd ddd dddd", "ddd-ddd-dddd", "(ddd) ddd-dddd", "ddd.ddd.dddd", "0dd dddddddd", "0ddd/ddddddd", "dd dd dd dd dd", "ddd ddd ddd")


def templates(n: int, seed: int) -> list[tuple[str, list[Span], list[int]]]:
    """Labelled sentences that the patterns can't label: numbers of the same shapes are phones after words that announce a call,
    and nobody's after words that count or order. (run, spans in it, words before)."""
    rng, out = np.random.default_rng(seed), []
    filled = lambda shape: "".join(str(rng.integers(10)) if c == "d" else c for c in shape)
    for i in range(n):
        calls = i % 2 == 0
        word, fill = str(rng.choice(CALLS if calls else COUNTS)), ["please", "und", "la", "me", "on"][rng.integers(5)]
        number = filled(str(rng.choice(LOCAL_PHONES)))
        text = f"{fill} {word}{['', ':', ' at'][rng.integers(3)]} {number}"
        at = text.index(number)
        out.append((number, [("phone", 0, len(number))] if calls else [], before(text, at)))
    return out


def _examples(text: str) -> list[tuple[str, list[Span], list[int]]]:
    """Runs of the text with their non-overlapping pattern spans, cut into pieces of whole words so that long ones train too."""
    out, base, j = [], base_spans(text), 0
    for at, run in runs(text):
        cut = 0
        while cut < len(run):
            stop = len(run) if len(run) - cut <= 400 else (run.rfind(" ", cut, cut + 400) if run.rfind(" ", cut, cut + 400) > cut else cut + 400)
            gold, last = [], at + cut
            while j < len(base) and base[j][1] < at + cut:
                j += 1
            for kind, a, b in base[j:]:
                if a >= at + stop:
                    break
                if a >= last and b <= at + stop:
                    gold.append((kind, a - at - cut, b - at - cut))
                    last = b
            out.append((run[cut:stop], gold, before(text, at + cut)))
            cut = stop + (stop < len(run) and run[stop] == " ")
    return out


def train(documents: DataFrame, sample: int = 600, sentences: int = 600) -> SemiCrf:
    """Fits the field on the runs of at most `sample` documents with a digit or at sign (least hash of doc_id and text first;
    the documented bound) and on `sentences` labelled templates. Very long texts train like others, in pieces. Without
    such documents the templates remain."""
    texts = documents.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    keyed = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = keyed.select("h").orderBy("h").limit(sample)  # narrow rows; runs of the chosen only reach the driver

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _examples(text)[:PIECES]
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([pickle.dumps(found)])], ["h", "found"])

    rows = keyed.join(F.broadcast(chosen.distinct()), "h").select("h", "text").distinct().mapInArrow(gather, "h bigint, found binary").collect()
    examples = [x for _, found in sorted((r["h"], bytes(r["found"])) for r in rows) for x in pickle.loads(found)]
    model = SemiCrf()
    model.w[0, 0] = 2.0
    return model.fit(examples + templates(sentences, 11))


#: Of one sampled document at most so many pieces train the field: a part of the sample's documented bound.
PIECES = 40


def find(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans), each by start, then kind."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # how far the spans up to each go
    added = []
    for at, run in runs(text):
        for kind, a, b in model.decode(run, before(text, at)):
            a, b = a + at, b + at
            i = bisect_left(starts, b)  # spans that start before b
            if not i or reach[i - 1] <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(documents: DataFrame, model: SemiCrf) -> DataFrame:
    """Per input row: doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans.

    spans lists kind:start:end in code points, end exclusive, joined by commas; base_sha256 is the hash of
    that list for pattern spans alone. Null and empty texts have none. Texts are read whole. Repeated rows
    give equal rows; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.w, model.near))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(*shared.value)
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                found = [find(t, model) if t and re.search("[0-9@]", t) else ([], []) for t in texts[lo:hi]]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                hashes = pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found], pa.string())
                every = pa.array([said(spans) for _, spans in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, hashes, every], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
