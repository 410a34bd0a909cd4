"""Toxicity by a counterfactually regularised classifier.

Logistic regression on which words a text holds (hashed to DIMENSIONS columns). Training adds a penalty on
how much the logit of a labelled sentence changes when identity terms are swapped, so that naming a group cannot carry
weight of its own; an L1 term keeps the words that decide few. There are two sorts of counterfactual pairs:

* a labelled text with identity terms, and the text with each swapped for another of its language and kind;
* a labelled text with one identity term put in, and the same text with another term of that language and kind in
  its place, or with none. Such pairs exist in every corpus, also where no text names a group: words of a text share
  hashed columns with terms that are not in it, and new texts will name them.

Both are differences of word columns, so a pair is a short sparse row. Terms are an argument (lang, kind, term); a
pair never depends on a row's language, and labels, lang, source and doc_id are no inputs of a score. The model is
fitted on the driver from a sample of at most `sample` labelled rows (the documented bound), as sparse rows of word
columns; all documents are scored on the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import utf8, words

DIMENSIONS = 1 << 18

#: Identity terms by language and kind; a term is swapped for others of its language and kind.
IDENTITY_TERMS = {
    ("en", "religion"): "christian christians muslim muslims jewish jew jews hindu hindus buddhist buddhists atheist atheists catholic catholics sikh sikhs".split(),
    ("en", "ethnicity"): "black white asian african european latino latina hispanic arab native indigenous immigrant immigrants refugee refugees".split(),
    ("en", "gender"): "man men woman women male female boy girl transgender nonbinary".split(),
    ("en", "orientation"): "gay lesbian bisexual straight queer homosexual heterosexual".split(),
    ("en", "ability"): "disabled blind deaf autistic elderly young".split(),
    ("de", "religion"): "christ christen muslim muslime jude juden hindu hindus buddhist buddhisten atheist atheisten katholik katholiken".split(),
    ("de", "ethnicity"): "schwarze weiße asiaten afrikaner europäer araber einwanderer flüchtling flüchtlinge ausländer".split(),
    ("de", "gender"): "mann männer frau frauen junge mädchen männlich weiblich".split(),
    ("de", "orientation"): "schwul lesbisch bisexuell homosexuell heterosexuell".split(),
    ("fr", "religion"): "chrétien chrétiens musulman musulmans juif juifs hindou hindous bouddhiste bouddhistes athée athées catholique catholiques".split(),
    ("fr", "ethnicity"): "noir noirs blanc blancs asiatique africain africains européen arabe arabes immigré immigrés réfugié réfugiés".split(),
    ("fr", "gender"): "homme hommes femme femmes garçon fille masculin féminin".split(),
    ("fr", "orientation"): "gay lesbienne bisexuel homosexuel hétérosexuel".split(),
    ("es", "religion"): "cristiano cristianos musulmán musulmanes judío judíos hindú hindúes budista budistas ateo ateos católico católicos".split(),
    ("es", "ethnicity"): "negro negros blanco blancos asiático africano europeo latino árabe árabes inmigrante inmigrantes refugiado refugiados".split(),
    ("es", "gender"): "hombre hombres mujer mujeres niño niña masculino femenino".split(),
    ("es", "orientation"): "gay lesbiana bisexual homosexual heterosexual".split(),
}
TERM_ROWS = [(lang, kind, term) for (lang, kind), terms in IDENTITY_TERMS.items() for term in terms]

_APART = np.ones(256, dtype=bool)  # bytes between words: ASCII other than letters and digits
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def columns_of(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct columns of its words (A-Z as a-z)."""
    hashes, bounds = words(*utf8(texts), space=_APART)
    at = (hashes >> np.uint64(64 - 18)).astype(np.int32)
    return [np.unique(at[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _term_columns(terms: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(column, group number) of every one-word identity term; a group is a language and kind of two terms or more."""
    found = columns_of(pa.array([t for *_, t in terms], pa.string()))
    names = sorted({(lang, kind) for lang, kind, _ in terms})
    kept = [(int(c[0]), names.index((lang, kind))) for c, (lang, kind, _) in zip(found, terms, strict=True) if len(c) == 1]
    several = [g for g in range(len(names)) if len({c for c, h in kept if h == g}) > 1]
    kept = [x for x in kept if x[1] in several]
    return np.array([c for c, _ in kept], np.int64), np.array([g for _, g in kept], np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of all columns
    bias: float
    swapped: int = 0  # counterfactual pairs of texts that hold identity terms
    inserted: int = 0  # counterfactual pairs of terms put into texts

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        logit = np.array([self.weights[r].sum() for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


Pair = tuple[np.ndarray, np.ndarray]  # columns that only the counterfactual has, and those that only the text has


def swaps(row: np.ndarray, terms: np.ndarray, groups: np.ndarray, rng: np.random.Generator) -> Pair | None:
    """The row against itself with each identity term swapped for another of its group; None if it has none."""
    at = np.flatnonzero(np.isin(terms, row))
    if not len(at):
        return None
    other = np.unique([rng.choice(terms[(groups == groups[i]) & (terms != terms[i])]) for i in at])
    new = np.union1d(np.setdiff1d(row, terms[at]), other)
    return np.setdiff1d(new, row), np.setdiff1d(row, new)


def insertion(row: np.ndarray, terms: np.ndarray, groups: np.ndarray, rng: np.random.Generator) -> Pair | None:
    """The row with one term put in, against it with another of the group, or (one time in two) with none."""
    one = rng.integers(len(terms))
    other = rng.choice(terms[(groups == groups[one]) & (terms != terms[one])])
    first, second = np.union1d(row, terms[one : one + 1]), np.union1d(row, [other]) if rng.random() < 0.5 else row
    pair = np.setdiff1d(first, second), np.setdiff1d(second, first)
    return pair if len(pair[0]) + len(pair[1]) else None


class Problem:
    """What is minimised, but for the L1 term: balanced logistic loss + swap_weight * mean squared logit change."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, pairs: list[Pair], swap_weight: float):
        self.y, self.weight, n = np.asarray(labels, np.float64), swap_weight, len(rows)
        every = [*rows, *[np.concatenate(p) for p in pairs]]
        flat = np.concatenate(every)
        place = np.zeros(DIMENSIONS, np.int64)
        place[flat] = 1
        self.used = np.flatnonzero(place)
        place[self.used] = np.arange(len(self.used))
        self.flat = place[flat]  # as np.unique's inverse, without its sorted copies
        self.of = np.repeat(np.arange(len(every)), [len(r) for r in every])
        self.sign = np.ones(len(flat))
        if pairs:
            self.sign[sum(map(len, rows)) :] = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs])
        self.n, self.m = n, len(pairs)
        self.terms = np.empty(len(self.flat))  # one number for each entry, made anew in every step
        self.balance = np.where(self.y == 1, 0.5 / self.y.sum(), 0.5 / (n - self.y.sum()))

    def slope(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """(value, its gradient by w, by the bias)."""
        sums = np.bincount(self.of, self._signed(w, self.flat), self.n + self.m)
        logit, change = np.clip(sums[: self.n] + bias, -40, 40), sums[self.n :]
        p = 1 / (1 + np.exp(-logit))
        value = (self.balance * (np.logaddexp(0, logit) - self.y * logit)).sum() + self.weight * (change**2).sum() / max(self.m, 1)
        pull = np.concatenate((self.balance * (p - self.y), 2 * self.weight * change / max(self.m, 1)))
        return value, np.bincount(self.flat, self._signed(pull, self.of), len(self.used)), pull[: self.n].sum()

    def _signed(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        np.take(values, at, out=self.terms, mode="clip")  # (with "raise" numpy makes a copy; all places exist)
        self.terms *= self.sign
        return self.terms


def fit(
    rows: list[np.ndarray], labels: np.ndarray, swap_weight: float = 1.0, l1: float = 2e-3, steps: int = 300, swaps_each: int = 2, seed: int = 7,
    terms: list[tuple[str, str, str]] | None = None,
) -> Model:
    """Proximal gradient with momentum on Problem's value + L1.

    Every row gives `swaps_each` swaps if it holds terms, and one insertion. Without rows of both classes
    the model is constant: their share, or 0. Warns if there are no pairs to compare (no terms were given).
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(DIMENSIONS), 40.0 if len(y) and y[0] else -40.0)
    rng = np.random.default_rng(seed)
    columns, groups = _term_columns(TERM_ROWS if terms is None else terms)
    swapped, inserted = [], []
    if len(columns):
        swapped = [p for r in rows for _ in range(swaps_each) if (p := swaps(r, columns, groups, rng)) is not None]
        inserted = [p for r in rows if (p := insertion(r, columns, groups, rng)) is not None]
    if not swapped and not inserted:
        warnings.warn("no counterfactual pairs: the classifier is fitted without its penalty", stacklevel=2)
    problem = Problem(rows, y, swapped + inserted, swap_weight)
    w, v, bias, momentum = np.zeros(len(problem.used)), np.zeros(len(problem.used)), 0.0, 1.0
    width = max(len(r) for r in rows)
    rate = 4.0 / (width**0.5 * 2 + 8 * swap_weight * bool(problem.m) + 1)
    for _ in range(steps):
        _, slope, bias_slope = problem.slope(v, bias)
        step = v - rate * slope
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        bias -= rate * bias_slope
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    weights = np.zeros(DIMENSIONS)
    weights[problem.used] = w
    return Model(weights, float(bias), len(swapped), len(inserted))


def false_positives(model: Model, rows: list[np.ndarray], threshold: float = 0.7, terms: list[tuple[str, str, str]] | None = None) -> float:
    """The share of (clean row, term) with a neutral mention of the term put in that score at least `threshold`."""
    columns, _ = _term_columns(TERM_ROWS if terms is None else terms)
    mentions = [np.union1d(r, [c]) for r in rows for c in columns]
    return float((model.scores(mentions) >= threshold).mean()) if mentions else 0.0


def _collected(labelled: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Word columns and labels of the sample (text, toxic), in a fixed order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                rows = pa.array(columns_of(batch.column(0)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows, batch.column(1)], ["columns", "toxic"])

    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "columns array<int>, toxic int").toArrow()
    lists = found.column(0).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    labels = found.column(1).to_numpy()
    flat, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    rows = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i].tobytes()))
    return [rows[i] for i in order], labels[order]


def labelled_rows(documents: DataFrame, labels: DataFrame, sample: int = 10_000, positives: float = 0.3) -> tuple[list[np.ndarray], np.ndarray]:
    """(word columns, toxic) of at most `sample` labelled rows, `positives` of them toxic at most: those with the least
    hash of doc_id. Null labels, ids and texts are left out; a doc_id with several labels keeps each."""
    known = labels.where(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    order = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic")
    some = [order.where(F.col("toxic") == 1).limit(int(sample * positives)), order.where(F.col("toxic") != 1).limit(sample - int(sample * positives))]
    chosen = some[0].unionByName(some[1]).drop("h")
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    return _collected(texts.join(F.broadcast(chosen), "doc_id"))  # at most `sample` rows


def train(documents: DataFrame, labels: DataFrame, sample: int = 10_000, positives: float = 0.3, terms: DataFrame | None = None, **options) -> Model:
    """A model from labelled documents: fit() on labelled_rows().

    terms: identity terms (lang, kind, term) in place of TERM_ROWS, at most 10,000; terms of several words are left
    out. Without usable rows all scores are low. Equal rows and ties of hashes are taken in a fixed order; very long
    texts are read whole, as sets of at most DIMENSIONS columns.
    """
    given = None
    if terms is not None:
        given = [tuple(r) for r in terms.select("lang", "kind", "term").dropna().distinct().orderBy("lang", "kind", "term").limit(10_001).collect()]
        if len(given) > 10_000:
            raise ValueError("at most 10,000 identity terms")
    return fit(*labelled_rows(documents, labels, sample, positives), terms=given, **options)


def score(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """documents' columns and `into`, 0 to 1; null and empty texts get the bias' score.

    A column of that name (in any case) is replaced; give another name to keep it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c.lower() != into.lower()]
    place = kept.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                scores = pa.array(shared.value.scores(columns_of(batch.column(place))))
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, into])

    rows = documents.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` double")
