"""SentencePiece BPE by vectorised merge rounds over flat numpy arrays, and decoding.

The symbols of all distinct words of a batch stand one after another in flat arrays: symbol, word, and rank of the
pair that begins there. A round takes the least rank of each word (a segmented minimum), merges the leftmost pairs of that rank
in all words at once and looks up only the pairs beside a merge. When an eighth of the words has no pair left or half of the symbols are
merged, the arrays close up and finished words leave; it ends when none is left.

Several pairs of one word merge in one round only if that gives what merging one after the other gives: when no pair
that the merged piece could form ranks as high as the piece itself or higher. Otherwise the word merges its leftmost one alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import batches_of

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_SYMBOLS = 1 << 20  # of the words that merge together
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file; as large as its vocabulary."""

    pieces: list[str]
    scores: list[float]
    bytes_at: dict[int, int]  # id of a byte piece -> the byte
    control: frozenset[int]
    unknown: int
    unknown_surface: str


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece BPE file. ValueError if encoding needs more than is built here.

    Built: BPE with byte fallback, the identity normalizer with dummy prefix and escaped, unremoved white space, and
    no user-defined or unused pieces.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, norm, how = proto.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if how.model_type != how.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix or not plain:
        raise ValueError("a BPE model with byte fallback, dummy prefix and identity normalizer is needed")
    known = {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}
    if any(p.type not in known for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not built")
    of = lambda t: [i for i, p in enumerate(model.pieces) if p.type == t]
    pieces = [p.piece for p in model.pieces]
    return Vocabulary(
        pieces, [p.score for p in model.pieces], {i: int(pieces[i][1:-1], 16) for i in of(kind.BYTE)}, frozenset(of(kind.CONTROL)), of(kind.UNKNOWN)[0], how.unk_surface
    )


class PieceBpe:
    """Encoder and decoder; made once for each Python worker.

    A symbol is a piece's id; a character that occurs in pieces without being one has an id behind them; any other
    character is minus its code point minus one.
    """

    def __init__(self, v: Vocabulary, cached: int = 150_000):
        self.v, self.cached, self.cache = v, cached, {}
        apart = {*v.bytes_at, *v.control, v.unknown}
        symbol = {p: i for i, p in enumerate(v.pieces) if i not in apart}
        normal = dict(symbol)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(v.pieces) + len(symbol))
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that reach from one word into the next are not built")
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        self.raw: dict[int, list[int]] = {}  # ids of symbols that are no pieces
        self.byte_id = {b: i for i, b in v.bytes_at.items()}
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
                if c not in normal:
                    self.raw[i] = [self.byte_id[b] for b in c.encode()]
        order = {s: r for r, s in enumerate(sorted({v.scores[i] for i in normal.values()}, reverse=True))}
        keys, into = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    into.append(i)
        rank = np.zeros(len(v.pieces), np.int32)
        rank[list(normal.values())] = [order[v.scores[i]] for i in normal.values()]
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.into = np.array(keys, np.int64)[by], np.array(into, np.int32)[by]
        self.rank = rank
        # a piece that can form a pair of its own rank or better is merged one at a time
        self.alone = np.zeros(len(v.pieces) + len(symbol), bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            piece = side < len(v.pieces)
            better = rank[self.into[piece]] <= rank[side[piece]]
            self.alone[side[piece][better]] = True
        self.text = [b"" if i in v.control else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.text[v.unknown] = v.unknown_surface.encode()
        for i, b in v.bytes_at.items():
            self.text[i] = bytes([b])
        self.decimal = [str(i).encode() for i in range(len(v.pieces))]
        self.is_byte, self.is_mark = np.zeros((2, len(v.pieces)), bool)
        self.is_byte[list(v.bytes_at)], self.is_mark[list(v.control)] = True, True

    def _pairs(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; _NONE and -1 where there is none or the two are of different words."""
        rank, into = np.full(len(a), _NONE, np.int32), np.full(len(a), -1, np.int32)
        at = np.nonzero(same & (a >= 0) & (b >= 0))[0]
        key = a[at].astype(np.int64) << 32 | b[at]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        into[at[hit]] = self.into[slot[hit]]
        rank[at[hit]] = self.rank[into[at[hit]]]
        return rank, into

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols after all merges, word by word, and how many each word has."""
        lengths = np.array([len(w) for w in words])
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, into = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = True
        while len(sym):
            # what is left stands closed up: neighbours in `after` and `before`, words as segments of `starts`
            n = len(sym)
            inside = word[1:] == word[:-1]
            starts = np.nonzero(np.append(True, ~inside))[0]
            nth = np.cumsum(np.append(0, ~inside))
            after = np.where(np.append(inside, False), np.arange(1, n + 1), -1)
            before = np.where(np.append(False, inside), np.arange(-1, n - 1), -1)
            live, gone = np.ones(n, bool), 0
            if fresh:
                rank[:], into[:] = self._pairs(sym, sym[after], after >= 0)
                fresh = False
            while True:
                least = np.minimum.reduceat(rank, starts)
                over = least == _NONE
                if 2 * gone > n or over.all() or (8 * np.count_nonzero(over) > len(starts) and len(starts) > 1):
                    break
                hits = np.nonzero((rank == least[nth]) & (rank != _NONE))[0]
                run = np.append(True, after[hits[:-1]] != hits[1:])  # overlapping pairs: every second one of a run
                place = np.arange(len(hits))
                hits = hits[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
                first = np.append(True, nth[hits[1:]] != nth[hits[:-1]])
                single = np.logical_or.reduceat(self.alone[into[hits]], np.nonzero(first)[0])
                hits = hits[first | ~single[np.cumsum(first) - 1]]
                taken = after[hits]
                sym[hits], rank[taken], live[taken] = into[hits], _NONE, False
                gone += len(hits)
                beyond = after[taken]
                after[hits] = beyond
                before[beyond[beyond >= 0]] = hits[beyond >= 0]
                at = np.concatenate((hits, before[hits][before[hits] >= 0]))
                rank[at], into[at] = self._pairs(sym[at], sym[after[at]], after[at] >= 0)
            ended = over[nth] & live
            done.append((word[ended], sym[ended]))
            go = ~over[nth] & live
            sym, word, rank, into = sym[go], word[go], rank[go], into[go]
        of, out = (np.concatenate(x) for x in zip(*done, strict=True))
        return out[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _spelt(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in place of symbols: characters that are no pieces become their bytes."""
        odd = np.nonzero((symbols < 0) | (symbols >= len(self.v.pieces)))[0]
        if not len(odd):
            return symbols, sizes
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        bytes_of = [self.raw[s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "replace")] for s in kinds.tolist()]
        count = np.ones(len(symbols), np.int64)
        count[odd] = np.array([len(x) for x in bytes_of])[which]
        ids = np.repeat(symbols, count)
        at = np.repeat(np.cumsum(count)[odd] - count[odd], count[odd])
        within = np.arange(len(at)) - np.repeat(np.cumsum(count[odd]) - count[odd], count[odd])
        table = np.array([x + [0] * (4 - len(x)) for x in bytes_of], np.int32)
        ids[at + within] = table[np.repeat(which, count[odd]), within]
        of = np.repeat(np.arange(len(sizes)), sizes)
        return ids, np.bincount(of, weights=count, minlength=len(sizes)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words, each to be read after one space, into the cache: little-endian 32-bit integers."""
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (to == at or size + len(words[to]) < _SYMBOLS):
                size += len(words[to]) + 1
                to += 1
            ids, sizes = self._spelt(*self._merged([SPACE + w for w in words[at:to]]))
            raw, ends = ids.astype("<i4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            self.cache.update(zip(words[at:to], [raw[a:b] for a, b in zip([0, *ends], ends)]))  # noqa: B905 one start too many
            at = to

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words are what begins at a space, or a run of them; no piece reaches across."""
        split = [self._words(t) for t in texts]
        if len(self.cache) > self.cached:
            self.cache.clear()  # changes no result
        self._learn(list({w for words in split for w in words}.difference(self.cache)))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<i4") for words in split]

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words without their first space; the dummy prefix stands before the first word."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def decimals(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: the dummy prefix is taken off, each byte that is part of no character is U+FFFD."""
        parts = list(map(self.text.__getitem__, ids.tolist()))
        for k, part in enumerate(parts):  # the first that gives text loses the space before it
            if part:
                if not self.is_byte[ids[k]] and ids[k] != self.v.unknown and part[:1] == b" ":
                    parts[k] = part[1:]
                break
        whole = b"".join(parts)
        if not self.is_byte[ids].any():
            return whole
        try:
            if not self.is_mark[ids].any():  # a mark ends a run of bytes
                whole.decode()
                return whole
        except UnicodeDecodeError:
            pass
        return b"".join(self._lenient(parts, self.is_byte[ids].tolist()))

    @staticmethod
    def _lenient(parts: list[bytes], byte: list[bool]) -> Iterator[bytes]:
        """Runs of bytes read as UTF-8, with U+FFFD for each byte that is part of no character."""
        held = b""
        for part, is_byte in zip([*parts, b""], [*byte, False], strict=True):
            if is_byte:
                held += part
                continue
            while held:
                size = next((n for n in (1, 2, 3, 4) if _is_char(held[:n])), 0)
                yield held[:size] if size else "�".encode()
                held = held[size or 1 :]
            yield part


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_made: dict[int, PieceBpe] = {}


def _worker(shared) -> PieceBpe:
    """The worker's encoder, kept between tasks."""
    v = shared.value
    key = hash((len(v.pieces), v.pieces[-1], sum(v.scores), v.unknown))
    if key not in _made:
        _made.clear()
        _made[key] = PieceBpe(v)
    return _made[key]


def encode(documents: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the ids decoded again), token_ids.

    Ids are those of the sentencepiece library without begin and end ids and without sampling. Null text is the empty text and has no ids.
    Texts are encoded whole whatever their length; a word of n characters takes a round for every rank that merges in it, so
    time grows with n times that number (at most the vocabulary), and in runs of thousands of spaces with n squared. Repeated rows give equal
    rows; other columns are ignored. The model file is read on the driver and its vocabulary broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, 1 << 20):
                ids = bpe.encode([t or "" for t in texts[lo:hi]])
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(bpe.decimals(x)).hexdigest() for x in ids]),
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
