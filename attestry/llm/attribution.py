"""Token counts by section: whole documents are encoded once and token spans meet section spans.

Rule for tokens that cross boundaries: a token belongs to the section with which it shares most characters,
to the earlier one on a tie; a token that shares none with any section stays without one (section null).
Token spans come from the byte lengths of the tokens; a token of some bytes of a character spans it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import batches_of


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of tokens, given the byte length of every id."""
    ends = np.cumsum(lengths[ids]) if ids else np.zeros(0, np.int64)
    starts = ends - lengths[ids] if ids else ends
    if len(text) == (ends[-1] if ids else 0):  # one byte a character
        return starts, ends
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    number = np.cumsum(lead) - 1  # the character of each byte
    return number[starts], number[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether the token crosses a boundary). Sections are disjoint and ascending."""
    first = np.searchsorted(section_ends, starts, "right")  # the first section that ends after the token starts
    last = np.searchsorted(section_starts, ends, "left") - 1  # the last that starts before it ends
    owner = np.where(last >= first, first, -1)
    crossing = last > first
    for i in np.flatnonzero(crossing):
        spans = np.arange(first[i], last[i] + 1)
        shared = np.minimum(section_ends[spans], ends[i]) - np.maximum(section_starts[spans], starts[i])
        owner[i] = spans[shared.argmax()]  # argmax takes the earlier on ties
    inside = owner >= 0
    at = owner[inside]
    crossing[inside] |= (starts[inside] < section_starts[at]) | (ends[inside] > section_ends[at])
    return owner, crossing


_made: dict[str, tuple] = {}


def _worker(blob: bytes, pattern: str):
    key = f"{hash(blob)} {pattern}"
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            lengths[i] = len(t)
        _made.clear()
        _made[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _made[key]


def attribute(documents: DataFrame, ranks_path: str, pattern: str, spans: str | None = None) -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_crossing) for each section of each document.

    `spans` names a column array<struct<start, end>> of disjoint ascending character spans (fields,
    sections); without it every line is a section. Tokens in no section make a row with null section, if
    there are any. n_crossing counts the section's tokens that reach over its bounds. Documents without
    sections and tokens (null, empty) have no rows. Repeated rows give repeated rows; other columns are
    ignored.
    """
    with open(ranks_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.select("doc_id", "text", F.col(spans).alias("spans")) if spans else documents.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _worker(shared.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given_spans = batch.column(2) if spans else None
            for lo, hi in batches_of(texts):
                out: list[list] = [[], [], [], [], [], []]
                for i in range(lo, hi):
                    text = texts[i] or ""
                    if spans:
                        at = [(x["start"], x["end"]) for x in given_spans[i].as_py() or []]
                        bounds = np.array(at, np.int64).reshape(-1, 2)
                    else:
                        ends = np.cumsum([len(x) for x in text.split("\n")], dtype=np.int64) + np.arange(1, text.count("\n") + 2)
                        ends[-1] -= 1
                        bounds = np.stack((np.concatenate(([0], ends[:-1])), ends), 1) if text else np.zeros((0, 2), np.int64)
                    starts, stops = token_spans(text, encoding.encode_ordinary(text), lengths)
                    owner, crossing = allocate(starts, stops, bounds[:, 0], bounds[:, 1])
                    n = np.bincount(owner + 1, minlength=len(bounds) + 1)
                    over = np.bincount(owner + 1, weights=crossing, minlength=len(bounds) + 1)
                    rows = range(0 if n[0] else 1, len(bounds) + 1)
                    out[0] += [ids[i]] * len(rows)
                    out[1] += [r - 1 if r else None for r in rows]
                    out[2] += [int(bounds[r - 1, 0]) if r else None for r in rows]
                    out[3] += [int(bounds[r - 1, 1]) if r else None for r in rows]
                    out[4] += [int(n[r]) for r in rows]
                    out[5] += [int(over[r]) for r in rows]
                columns = [pa.array(out[0], batch.column(0).type), *[pa.array(x, pa.int64()) for x in out[1:]]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return given.mapInArrow(run, f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
