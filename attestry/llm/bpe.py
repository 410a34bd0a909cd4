"""Byte-level BPE over numpy matrices, and decoding.

Pieces of equal length class form padded matrices of ids, a row for each distinct piece. In every round each
row merges its leftmost pair of least rank; ranks of pairs come from a hash table in arrays, and only the two
pairs beside a merge are looked up again. Rows close up after a merge and leave the matrix when no pair
of theirs is in the table. Pieces longer than LONG bytes, where rounds would be many, are merged one by one
with a heap under the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .pieces import Encoder

LONG = 256  # bytes
#: Entries of a worker's caches at most. They are emptied when full: memory is bounded, and what comes again is encoded again.
CHUNKS, PIECES = 120_000, 60_000
_NONE = np.int32(2**31 - 1)
_CELLS = 1 << 19  # of a matrix


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 and rank on each line). Ranks must be 0..n-1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Bpe:
    """Encodes pieces by ranks; made once for each Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self._build(np.array(keys, np.uint64), np.array(values, np.int32))
        self.cache: dict[str, bytes] = {}
        self.texts = Encoder(self._chunks, limit=CHUNKS)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            self.keys[slot[left[free]]] = keys[left[free]]  # of several keys for a slot the last stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where there is none or b is padding (-1)."""
        out = np.full(a.shape, _NONE, np.int32)
        at = np.nonzero((a >= 0) & (b >= 0))
        keys = a[at].astype(np.uint64) << np.uint64(32) | b[at].astype(np.uint64)
        slot, found, left = self._slot(keys), np.full(len(keys), _NONE, np.int32), np.arange(len(keys))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != np.uint64(2**64 - 1))]
            slot[left] = (slot[left] + 1) & self.mask
        out[at] = found
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length."""
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        flat = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        done: list[np.ndarray] = [ids[0, :0]] * len(pieces)
        rows = np.arange(len(pieces))
        pair = self.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), _NONE, np.int32)
        while len(rows):
            best = pair.argmin(1) if pair.shape[1] else np.zeros(len(rows), np.int64)
            least = pair[np.arange(len(rows)), best] if pair.shape[1] else np.full(len(rows), _NONE)
            over = least == _NONE
            if over.any():
                for r, row, n in zip(rows[over].tolist(), ids[over], lengths[over].tolist(), strict=True):
                    done[r] = row[:n]
                go = ~over
                rows, ids, pair, best, least, lengths = rows[go], ids[go], pair[go], best[go], least[go], lengths[go]
                if not len(rows):
                    break
            n, w = ids.shape
            i = np.arange(n)
            ids[i, best] = least
            keep = np.ones((n, w), bool)
            keep[i, best + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            lengths = lengths - 1
            if w == 2:
                pair = np.full((n, 0), _NONE, np.int32)
                continue
            gone = np.ones((n, w - 1), bool)
            gone[i, best] = False
            pair = pair[gone].reshape(n, w - 2)
            right = best < w - 2
            pair[i[right], best[right]] = self.ranks(ids[i[right], best[right]], ids[i[right], best[right] + 1])
            left = best > 0
            pair[i[left], best[left] - 1] = self.ranks(ids[i[left], best[left] - 1], ids[i[left], best[left]])
            longest = int(lengths.max())
            if longest < ids.shape[1]:
                ids, pair = ids[:, :longest], pair[:, : longest - 1]
        return done

    def _one_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a heap of (rank, place) with links to neighbours; stale entries are skipped."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.ranks(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        now = first.tolist() + [int(_NONE)]
        heap = [(r, i) for i, r in enumerate(now) if r != _NONE]
        heapq.heapify(heap)
        table: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            if i < 0 or after[i] < 0:
                return int(_NONE)
            key = ids[i], ids[after[i]]
            if key not in table:
                table[key] = int(self.ranks(np.array([key[0]]), np.array([key[1]]))[0])
            return table[key]

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            ids[i], after[i], now[j], ids[j] = r, after[j], -1, -1
            if after[j] >= 0:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = rank(k)
                    if now[k] != _NONE:
                        heapq.heappush(heap, (now[k], k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def pieces(self, distinct: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        raw = [p.encode() for p in distinct]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        out: list[bytes] = [b""] * len(raw)
        at = 0
        while at < len(order):
            n = len(raw[order[at]])
            if n > LONG:
                out[order[at]] = self._one_long(raw[order[at]]).astype("<u4").tobytes()
                at += 1
                continue
            top = min(LONG, n if n <= 16 else n + n // 4)  # one length class
            to = at
            while to < len(order) and len(raw[order[to]]) <= top and (to - at + 1) * top <= _CELLS:
                to += 1
            for i, ids in zip(order[at:to], self._matrix([raw[i] for i in order[at:to]]), strict=True):
                out[i] = ids.astype("<u4").tobytes()
            at = to
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.pattern.findall(c) for c in chunks]
        new = list({p for parts in split for p in parts if p not in self.cache})
        if len(self.cache) + len(new) > PIECES:
            self.cache.clear()
            new = list({p for parts in split for p in parts})
        self.cache.update(zip(new, self.pieces(new), strict=True))
        return [b"".join([self.cache[p] for p in parts]) for parts in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.texts(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[int, Bpe] = {}


def _worker(shared, pattern: str) -> Bpe:
    """The worker's encoder, kept between tasks."""
    key = hash((shared.value[0], len(shared.value), pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(shared.value, pattern)
    return _made[key]


def text_runs(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list]]:
    """(start, end, texts) of runs of about `size` bytes of a column of texts; only one run is turned into strings at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = min(len(column), int(np.searchsorted(ends, before + size)) + 1)
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def encode(documents: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again), and token_ids.

    Null text encodes as the empty text: no ids. Texts are encoded whole whatever their length. Repeated rows
    give equal rows; other columns are ignored. `ranks_path` is read on the driver and the table (some MB,
    as large as the vocabulary) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared, pattern)
        for batch in batches:
            for lo, hi, texts in text_runs(batch.column(1)):
                coded = bpe.encode([t or "" for t in texts])
                ids = [np.frombuffer(c, "<u4") for c in coded]
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)
