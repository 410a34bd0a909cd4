"""N-gram Jaccard join by PartEnum signatures, and the classes of near-duplicate documents.

Sets of size a and b with Jaccard similarity of at least p % differ in at most (a + b)(100 - p)/(100 + p)
elements. Size bands make instances: instance j joins sets whose larger size lies in band j. In an instance
the feature domain (shingle hashes) is cut into parts; sets that differ in at most k elements differ in at
most k parts, so they agree on some choice of the others. With few differences all subsets of n - k of
n = k + 2 parts are enumerated. With more, each part is a group of its own and a set emits its first
k + 1 non-empty parts, largest first: the first part on which two similar sets agree is among those of both. A set with
too few non-empty parts for that also emits its first k + 1 elements, as a prefix filter. So similar sets
always share a signature; every candidate is verified on the whole sets.

Classes: exact copies of a set collapse first. Each set's elements that no other candidate has bound what it
can have in common with any, and parities of hashed elements bound in how many two sets differ at least. Members of a signature group meet the member with the
fewest such elements; verified links give classes, and only pairs that the bound allows and that are still in
different classes are compared after that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, written
from .graph import components
from .hashing import mix, shingle_sets

_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E5B1F1C35), np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1
_ENUMERATED = 3  # up to so many differing elements all subsets of parts are enumerated


@lru_cache(maxsize=8)
def _bands(percent: int) -> list[int]:
    """First sizes of the bands; the next is larger by 100 / percent."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


@lru_cache(maxsize=65536)
def _instances(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(instance, its largest number of differences, the largest with a set of this size) for each instance."""
    first, out = _bands(percent), []
    j = bisect_left(first, size + 1) - 1
    while -(-first[j] * percent // 100) <= size:
        top = first[j + 1] - 1
        partner = min(size * 100 // percent, top)
        out.append((j, 2 * top * (100 - percent) // (100 + percent), (size + partner) * (100 - percent) // (100 + percent)))
        j += 1
    return tuple(out)


_PARITY = [f"p{i}" for i in range(8)]


def parities(hashes: np.ndarray) -> np.ndarray:
    """512 bits as eight integers: whether an odd number of hashes falls on each. Sets differ in at least as many
    elements as their parities differ in bits."""
    odd = (np.bincount((mix(hashes ^ _C) >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Distinct signatures (uint64) of a set given as sorted hashes."""
    if not len(hashes):
        return hashes
    mixed, high, out = mix(hashes ^ _A), hashes >> np.uint64(32), []
    for j, most, own in _instances(len(hashes), percent):
        seed = np.uint64((j + 1) * int(_C) & _ALL)
        parts = 1 if not most else most + 2 if most <= _ENUMERATED else most + 2 + most // 4
        part = (high * np.uint64(parts)) >> np.uint64(32)
        at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        sums, ids = np.add.reduceat(mixed, at), part[at]
        if most <= _ENUMERATED:
            full = np.zeros(parts, np.uint64)
            full[ids.astype(np.intp)] = mix(sums + ids * _B)
            for chosen in combinations(range(parts), parts - most):
                total = full[list(chosen)].sum(dtype=np.uint64)
                if total:
                    code = sum(1 << c for c in chosen)
                    out.append(mix(np.array([(int(total) + int(seed) + code) & _ALL], np.uint64)))
            short, prefix = len(ids) <= most, most + 1
        else:
            # Any order that depends on parts and their contents alone will do; large parts are the rarest.
            first = np.argsort(-np.diff(at, append=len(mixed)), kind="stable")[: own + 1]
            out.append(mix(mix(sums + ids * _B)[first] + seed))
            short, prefix = len(ids) <= own, own + 1
        if short:
            out.append(mix(hashes[:prefix] ^ _B))
    return np.unique(np.concatenate(out))


def _documents(shingle_words: int, percent: int, what: str):
    """A mapInArrow function: (doc_id, text) -> (doc_id, n, k1, k2) and `signatures` or the `set` itself; as `key`
    (doc_id, text, text_key) -> (doc_id, n, k1, k2, text_key)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = list(shingle_sets(batch.column(1), shingle_words))
                key = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ _C).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
                columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1])]
                names = ["doc_id", "n", "k1", "k2"]
                if what == "key":
                    columns.append(batch.column(2))
                    names.append("text_key")
                else:
                    each = [signatures(s, percent) for s in sets] if what == "signatures" else sets
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                    values = np.concatenate(each).view(np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                    names.append("hashes")
                if what == "set":
                    bits = np.stack([parities(s) for s in sets])
                    columns += [pa.array(bits[:, i]) for i in range(8)]
                    names += _PARITY
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, node) sorted by sig, those whose sig is not theirs alone. Holds one row between batches."""
    held, tied = None, False  # the last row, and whether it goes with the row before it
    for batch in batches:
        sig, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(sig):
            continue
        if held is not None:
            sig, node = np.concatenate(([held[0]], sig)), np.concatenate(([held[1]], node))
        same = sig[1:] == sig[:-1]
        keep = np.concatenate(([tied], same)) | np.concatenate((same, [False]))
        held, tied = (sig[-1], node[-1]), bool(same[-1]) if len(same) else tied
        keep[-1] = False  # decided with the next batch
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])
    if tied:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], ["sig", "node"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those with 100 * |intersection| >= percent * |union|. sets: (node, hashes)."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("common"), (F.size("ha") + F.size("hb") - common).alias("union"))
        .where(F.col("common") * 100 >= F.col("union") * percent)
        .select("a", "b")
    )


def _may_match(percent: int) -> Column:
    """Whether sets of sizes na and nb, of which ua and ub elements are in no other set, can be similar: they
    have at most the smaller rest in common, and differ in at least as many elements as their parities do."""
    both = F.col("na") + F.col("nb")
    common = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in _PARITY), F.lit(0))
    return (common * (100 + percent) >= both * percent) & (apart * (100 + percent) <= both * (100 - percent))


def text_key(text: Column) -> Column:
    """A hash that tells the texts of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_classes(documents: DataFrame, shingle_words: int = 5, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, k1, k2 (the two hashes that stand for the set), text_key, class_id.

    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have an empty set,
    no links and their own doc_id. Repeated rows have equal results. Rows of one doc_id with other texts are
    documents of their own that share a number. Null doc_ids never become a component_id unless no member
    has one. Other columns are ignored. Classes of such rows can have equal component_ids; class_id tells every
    class apart (null for empty sets), text_key the texts of one doc_id.
    """
    docs = documents.select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {kind}, n bigint, k1 bigint, k2 bigint"
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    keyed = written(texts.mapInArrow(_documents(shingle_words, percent, "key"), head + ", text_key bigint"), "keys")

    # A node for each distinct set, numbered by its smallest doc_id; by a hash where that number isn't unique.
    nodes = keyed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    shared = nodes.groupBy(F.col("rep").alias("r")).agg(F.count("*").alias("sets")).where("sets > 1")
    own = F.col("r").isNull() & F.col("rep").isNotNull()
    nodes = nodes.join(shared, F.col("rep") == F.col("r"), "left").select(
        "k1", "k2", "rep", "n", F.when(own, F.col("rep").cast("long")).otherwise(F.xxhash64("k1", "k2")).alias("node")
    )
    nodes = written(nodes, "nodes")
    # Rows that don't stand for their node under their own doc_id: copies (dropped), and renumbered nodes.
    renamed = keyed.where("n > 0").select("doc_id", "k1", "k2").join(nodes.select("k1", "k2", "rep", "node"), ["k1", "k2"])
    renamed = renamed.where(~F.col("doc_id").cast("long").eqNullSafe(F.col("node"))).groupBy("doc_id", "k1", "k2").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("rep")), F.col("node"))).alias("other")
    )
    renamed, _ = small_side(written(renamed.withColumnsRenamed({"doc_id": "d", "k1": "x1", "k2": "x2"}), "renamed"), broadcast_rows)

    def standing(rows: DataFrame) -> DataFrame:
        """One node column; rows of copies go."""
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
        rows = rows.where("n > 0").join(renamed, same, "left").where(F.col("x1").isNull() | F.col("other").isNotNull())
        return rows.withColumn("node", F.coalesce("other", F.col("doc_id").cast("long"))).drop("d", "x1", "x2", "other")

    signed = standing(docs.mapInArrow(_documents(shingle_words, percent, "signatures"), head + ", hashes array<bigint>"))
    shuffles = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = signed.select(F.explode("hashes").alias("sig"), "node").repartition(shuffles, "sig")
    groups = signed.sortWithinPartitions("sig").mapInArrow(_runs, "sig bigint, node bigint")
    groups = written(groups, "groups")

    # Whole sets of all members of groups. An element that no other member has is in no other document's set
    # that could be similar; a set with too many of these has no links and leaves its groups.
    need, _ = small_side(written(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "rep"), "members"), broadcast_rows)
    texts = docs.join(need.select(F.col("rep").alias("r")), F.col("doc_id").eqNullSafe(F.col("r")), "left_semi")
    sets = standing(texts.mapInArrow(_documents(shingle_words, percent, "set"), head + ", hashes array<bigint>" + "".join(f", {p} bigint" for p in _PARITY)))
    sets = written(sets.join(need.select("node"), "node", "left_semi").select("node", "n", "hashes", *_PARITY).dropDuplicates(["node"]), "sets")
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    alone = alone.where("holders = 1").groupBy("node").agg(F.count("*").alias("u"))
    members = sets.drop("hashes").join(alone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    members = written(members.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent), "able")
    groups = written(groups.select("sig", "node").join(members, "node"), "able-groups")

    def side(x: str) -> list[Column]:
        return [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("u").alias(f"u{x}"), *[F.col(p).alias(f"{x}{p}") for p in _PARITY]]

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        return written(similar(written(pairs.distinct(), f"{label}-pairs"), sets, percent), f"{label}-links")

    # Every member meets the one with the fewest elements of its own, which is near to most of its group.
    hub = groups.groupBy("sig").agg(F.min("u").alias("u"), F.count("*").alias("size")).where("size > 1")
    hub = groups.join(hub, ["sig", "u"]).groupBy("sig").agg(F.min("node").alias("a")).join(members.select(*side("a")), "a")
    star = groups.select("sig", *side("b")).join(hub, "sig")
    star = star.where(F.col("a") != F.col("b")).where(_may_match(percent))
    links = verified(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "star")
    classes = components(links)

    # Groups that still span classes: members outside the group's largest class meet all members of others.
    placed = groups.join(classes, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    split = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    placed = written(placed.join(split, "sig", "left_semi"), "split")
    largest = placed.groupBy("sig", "c").agg(F.count("*").alias("size")).groupBy("sig").agg(F.max(F.struct("size", "c"))["c"].alias("main"))
    stray = placed.join(largest, "sig").where("c <> main").select("sig", F.col("c").alias("ca"), *side("a"))
    rest = stray.join(placed.select("sig", F.col("c").alias("cb"), *side("b")), "sig").where((F.col("ca") != F.col("cb")) & _may_match(percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(verified(rest, "rest"))
    classes = components(links)

    named = nodes.join(classes, "node", "left").select("k1", "k2", "rep", F.coalesce("component", "node").alias("c"))
    lowest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "c").select("k1", "k2", "component_id", F.col("c").alias("class_id"))
    return keyed.join(named, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "k1",
        "k2",
        "text_key",
        "class_id",
    )
