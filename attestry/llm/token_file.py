"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file set is a Parquet folder whose rows are segments, ordered by (part, seq): ids of whole documents in
ascending doc_id order as one binary array of 16-bit ids (32-bit where the vocabulary needs it), the
documents' numbers and their end offsets as Elias-Fano sequences, and the number of ids before the segment
in its part. A part's own start is the sum over the parts before it: one number for each part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elias_fano import Sequence, pack
from .pieces import Encoder, batches_of

#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT = 1 << 20

SCHEMA = "part int, seq int, n_docs bigint, n_null bigint, id_base bigint, base bigint, n_ids bigint, width int, doc_ids binary, bounds binary, ids binary"

#: Distinct chunks that the library gets at once.
RUN = 8192
#: A space in the tokens of a byte-level vocabulary.
_SPACE = "\u0120"

_made: dict[str, Encoder] = {}


def _encoder(blob: str, width: str, marks_as_text: bool) -> Encoder:
    """The worker's encoder, kept between tasks."""
    key = f"{hash(blob)} {width} {marks_as_text}"
    if key not in _made:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(blob)
        tokenizer.encode_special_tokens = marks_as_text

        # A token that begins with a space; added tokens are matched as they stand and hold none.
        added = set(tokenizer.get_added_tokens_decoder())
        spaced = np.zeros(1 + max([0, *added, *tokenizer.get_vocab().values()]), bool)
        spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith(_SPACE) and i not in added]] = True

        def cut(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
            flat, cuts = ids.tobytes(), (at * ids.itemsize).tolist()
            return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        def apart(some: list[str]) -> list[bytes]:
            coded = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            of = np.array(coded.word_ids, np.int64)  # ascending
            return cut(np.array(coded.ids, width), np.searchsorted(of, np.arange(len(some) + 1)))

        def joined(some: list[str]) -> list[bytes]:
            """Of chunks with their only space in front, none white beside it, as one text: each begins with the token that holds its space."""
            ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, width)
            at = np.flatnonzero(spaced[ids])
            return cut(ids, np.append(at, len(ids))) if len(at) == len(some) and at[0] == 0 else apart(some)

        def encode(chunks: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(chunks), RUN):
                some = chunks[at : at + RUN]
                odd = [c for c in some if c.rfind(" ") or len(c) < 2 or c[1].isspace() or c[-1].isspace()]
                if not odd:
                    out += joined(some)
                    continue
                known = dict(zip(odd, apart(odd), strict=True))
                lone = [c for c in some if c not in known]
                known.update(zip(lone, joined(lone) if lone else [], strict=True))
                out += map(known.__getitem__, some)
            return out

        def each(texts: list[str]) -> list[bytes]:
            return [np.array(x.ids, width).tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

        _made.clear()
        _made[key] = Encoder(encode, limit=600_000)
        _made[key].whole = each
    return _made[key]


def write(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, partitions: int | None = None, marks_as_text: bool = False, whole: bool = False) -> None:
    """Writes the file set of documents (doc_id, text) to `path`, a folder that Spark can write.

    Ids are those of the tokenizers library for the whole text, add_special_tokens=False. A string of the file's special
    tokens in a text becomes the special id, as the library does by default; with `marks_as_text` it is ordinary
    text. The library is not called for every text: texts are split at lone spaces, which neither the pattern of the
    pre-tokenizer nor a special token crosses, every distinct piece is encoded once a task, many as one text, and remembered
    (see pieces.Encoder). `whole` calls the library for every whole text; the ids are the same.

    Null text is the empty text: only the end id. Null doc_ids come first; rows with one doc_id are ordered
    by text. Other columns are ignored. No documents make an empty file set. Texts of any length are
    encoded whole. doc_ids are whole numbers or null; others are refused. The tokenizer must be byte-level BPE with the
    pattern of that pre-tokenizer and without normalizer, prefix space, or special tokens with spaces; its
    file is read on the driver.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    told = json.loads(blob)
    pre = told["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = told["added_tokens"]
    if told["normalizer"] or not plain or told["model"].get("type") != "BPE" or any(t["content"] != "".join(t["content"].split()) or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
        raise ValueError("a byte-level BPE tokenizer without normalizer, prefix space and special tokens with spaces is needed")
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be a whole number")
    top = max([end_id, *told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])])
    width = "<u2" if top < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(blob)
    end = np.array([end_id], width).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, unit = _encoder(shared.value, width, marks_as_text), np.dtype(width).itemsize
        encode = encoder.whole if whole else encoder
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        numbers: list[int | None] = []
        size = 0

        def segment() -> pa.RecordBatch:
            known = np.array([x for x in numbers if x is not None], np.int64)
            lowest = int(known[0]) if len(known) else 0
            row = {
                "part": part, "seq": seq, "n_docs": len(held), "n_null": len(held) - len(known), "id_base": lowest, "base": base,
                "n_ids": size, "width": unit, "doc_ids": pack((known - lowest).astype(np.uint64)),
                "bounds": pack(np.cumsum([len(x) // unit for x in held])), "ids": b"".join(held),
            }
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                for number, coded in zip(ids[lo:hi], encode([t or "" for t in texts[lo:hi]]), strict=True):
                    numbers.append(number)
                    held.append(coded + end)
                    size += len(coded) // unit + 1
                    if size >= SEGMENT:
                        yield segment()
                        seq, base, size = seq + 1, base + size, 0
                        held, numbers = [], []
        if held:
            yield segment()

    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(count, "doc_id", F.xxhash64("text"))
    ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids binary of little-endian 32-bit ids), a row for each document of the file set."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, before = [], 0
    for part, n in totals:  # as many as the file set has parts
        starts.append((part, before))
        before += n
    bases = spark.createDataFrame(starts, "part int, part_base bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                ends, known = Sequence(row["bounds"]).all(), Sequence(row["doc_ids"]).all() + row["id_base"]
                numbers = [None] * row["n_null"] + known.tolist()
                begins = np.concatenate(([0], ends[:-1]))
                for lo in range(0, len(ends), 512):
                    hi = min(lo + 512, len(ends))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers[lo:hi], pa.int64()),
                            pa.array(begins[lo:hi] + row["base"] + row["part_base"]),
                            pa.array(ends[lo:hi] - begins[lo:hi]),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(begins[lo:hi], ends[lo:hi], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "token_ids"],
                    )

    joined = segments.join(F.broadcast(bases), "part").select(*[c for c in segments.columns], "part_base")
    return joined.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def documents_at(spark: SparkSession, path: str, places: list[tuple[int, int, int]]) -> DataFrame:
    """(part, seq, nth, doc_id, start, n_tokens, token_ids) of chosen documents: the nth (from 0) of segment (part, seq).

    Only the segments in question are read; offsets come from the select structures, without unpacking the others'.
    start counts from the part's first id. Places that the file set doesn't have give no row.
    """
    asked = spark.createDataFrame(places, "part int, seq int, nth bigint")
    rows = spark.read.schema(SCHEMA).parquet(path).join(F.broadcast(asked), ["part", "seq"])  # as many as were asked for

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, known, n = Sequence(row["bounds"]), Sequence(row["doc_ids"]), row["nth"]
                if not 0 <= n < len(bounds):
                    continue
                a, b = bounds.select(n - 1) if n else 0, bounds.select(n)
                number = known.select(n - row["n_null"]) + row["id_base"] if n >= row["n_null"] else None
                ids = np.frombuffer(row["ids"], f"<u{row['width']}", b - a, a * row["width"])
                values = [row["part"], row["seq"], n, number, row["base"] + a, b - a, ids.astype("<u4").tobytes()]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
                names = ["part", "seq", "nth", "doc_id", "start", "n_tokens", "token_ids"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return rows.mapInArrow(run, "part int, seq int, nth bigint, doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() returns."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
