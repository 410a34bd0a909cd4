"""Merkle manifests of tables by time-forward processing.

Nodes are labelled (tree, level, index); a digest is a message to the label of its parent. Messages wait in a priority queue
ordered by label and are taken from it in that order, so a parent finds the digests of its run together. The queue is external: labels
are cut into blocks of `levels` levels below one node; what goes to a label of the same block stays in the task's heap, what goes to a later
one is written, and Spark's shuffle brings it to its block in the next tier. A tier is one shuffle of as many rows as it has nodes, and each
has fan_out ** levels times fewer than the one before. The reversed sweep goes from the root down the same tiers: a node sends its
children their siblings and what it was sent itself, so every leaf receives its whole proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_side, written

#: Two strings for a level: the run's other digests before the node, and those after it.
Path = list[str]
Finish = Callable[[pa.Table, list[Path], str], pa.Table]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: for each column `-` if null, else the bytes of its value as text, `:`, and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def depth(n: int, fan_out: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fan_out), out + 1
    return out


def sweep_up(first: int, digests: list[str], levels: int, fan_out: int) -> dict[tuple[int, int], str]:
    """Digests by (level, index) of a block, whose lowest nodes have the indices from `first` on."""
    queue = [((0, first + i), d) for i, d in enumerate(digests)]  # in order, so a heap
    known: dict[tuple[int, int], str] = {}
    while queue:
        (level, index), d = heapq.heappop(queue)
        known[level, index] = d
        if level == levels:
            continue
        run = [d]
        while queue and queue[0][0] < (level, (index // fan_out + 1) * fan_out):
            label, d = heapq.heappop(queue)
            known[label] = d
            run.append(d)
        heapq.heappush(queue, ((level + 1, index // fan_out), digest("".join(run))))
    return known


def sweep_down(known: dict[tuple[int, int], str], top: tuple[int, int], above: Path, fan_out: int) -> dict[int, Path]:
    """The paths of a block's lowest nodes by index; `above` is that of its top node."""
    queue: list[tuple[int, int, Path]] = [(-top[0], -top[1], above)]
    out: dict[int, Path] = {}
    while queue:
        level, index, path = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            out[index] = path
            continue
        run = [i for i in range(index * fan_out, (index + 1) * fan_out) if (level - 1, i) in known]
        for k, i in enumerate(run):
            before, after = ("".join(known[level - 1, j] for j in js) for js in (run[:k], run[k + 1 :]))
            heapq.heappush(queue, (1 - level, -i, [before, after, *path]))
    return out


def fold(d: str, path: Path) -> str:
    """The root that a leaf's digest and its path give."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        d = digest(before + d + after)
    return d


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with pos, their place in their tree by `order`, and n, the tree's size.

    Rows are sorted by ranges, numbered where they lie, and the counts of ranges before are added: no task gets a whole tree.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("row", 33)), "placed")
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    parts = parts.withColumn("start", F.sum("rows").over(W.partitionBy("tree").orderBy("part")) - F.col("rows")).withColumn("n", F.sum("rows").over(W.partitionBy("tree")))
    parts, _ = small_side(written(parts.select("tree", "part", "n", (F.col("start") - F.col("first")).alias("shift")), "parts"))
    return ranged.join(parts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "shift", "part")


@dataclass
class Forest:
    """Trees over placed nodes (tree, pos, n, digest). `roots` has (tree, digest)."""

    tiers: list[DataFrame]
    fan_out: int
    levels: int
    roots: DataFrame

    @staticmethod
    def grow(nodes: DataFrame, fan_out: int, levels: int) -> Forest:
        """Goes up tier by tier; how many there are follows from the largest tree."""
        span = fan_out**levels
        nodes = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long"))
        tiers, largest = [nodes], nodes.agg(F.max("n")).first()[0] or 0

        def up(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            first, n = table.column("pos")[0].as_py(), table.column("n")[0].as_py()
            high = min(levels, depth(n, fan_out))
            known = sweep_up(first, table.column("digest").to_pylist(), high, fan_out)
            index = first // fan_out**high
            return pa.table({"tree": table.column("tree")[:1], "pos": pa.array([index], pa.int64()), "n": pa.array([-(-n // span)], pa.int64()), "digest": [known[high, index]]})

        while largest > 1:
            below = tiers[-1].where("n > 1").select("tree", "block", "pos", "n", "digest")
            tier = written(below.groupBy("tree", "block").applyInArrow(up, "tree string, pos long, n long, digest string"), "tier")
            tiers.append(tier.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long")))
            largest = -(-largest // span)
        roots = tiers[0].where("n = 1").select("tree", "digest")
        for tier in tiers[1:]:
            roots = roots.unionByName(tier.where("n = 1").select("tree", "digest"))
        return Forest(tiers, fan_out, levels, written(roots, "roots"))

    def paths(self, above: DataFrame, finish: Finish, schema: str) -> DataFrame:
        """Goes down again. `above` has (tree, path, more) of the roots; rows of lowest nodes get what finish(rows, paths, more) makes of them.

        `more` is a string that comes with a root and goes to all its nodes.
        """
        fan_out, levels = self.fan_out, self.levels

        def down(end: Finish):
            def one(nodes: pa.Table, sent: pa.Table) -> pa.Table:
                nodes = nodes.sort_by("pos")
                first, high = nodes.column("pos")[0].as_py(), min(levels, depth(nodes.column("n")[0].as_py(), fan_out))
                known = sweep_up(first, nodes.column("digest").to_pylist(), high, fan_out)
                found = sweep_down(known, (high, first // fan_out**high), sent.column("path")[0].as_py(), fan_out)
                return end(nodes, [found[at] for at in nodes.column("pos").to_pylist()], sent.column("more")[0].as_py())

            return one

        def keep(nodes: pa.Table, found: list[Path], more: str) -> pa.Table:
            return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos"), "path": pa.array(found, pa.list_(pa.string())), "more": [more] * len(found)})

        def entering(tier: DataFrame) -> DataFrame:
            """What the trees are sent whose root is a node of this tier."""
            return above.join(tier.where("n = 1").select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("pos"), "path", "more")

        sent = entering(self.tiers[-1])
        for tier in self.tiers[-2:0:-1]:
            met = tier.where("n > 1").groupBy("tree", "block").cogroup(sent.groupBy("tree", "pos"))
            sent = written(met.applyInArrow(down(keep), "tree string, pos long, path array<string>, more string"), "sent").unionByName(entering(tier))
        if len(self.tiers) > 1:
            sent = sent.unionByName(entering(self.tiers[0]))
        return self.tiers[0].groupBy("tree", "block").cogroup(sent.groupBy("tree", "pos")).applyInArrow(down(finish), schema)


def manifest(
    documents: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    held: dict[str, Column] | None = None,
    fan_out: int = 2,
    levels: int = 8,
    with_paths: bool = True,
) -> DataFrame:
    """Per input row: `order`, leaf, subroot, root, proof_sha256, folded_root, verified, and its path.

    A row's leaf is the digest of `columns`. Leaves of one value of `tree` ascend by `order`; every fan_out consecutive nodes, the last run fewer, even
    one, become the digest of theirs until one is left, the subroot. Subroots, ordered by value, nulls first, give the root in the same way. The
    path has two strings for each level: digests of the run before the node, and after it; proof_sha256 is the digest of all of them.

    `held` has columns as someone else holds them; folded_root is what the leaf of those values and the path give, and verified says whether that is the
    root. Without it the rows themselves are verified.

    Nulls in any column count as a value of their own; null `order` comes first. Rows with equal `order` are ordered by leaf, repeated rows then as they
    come: their digests are equal, so no result depends on it but whose path is whose. An empty table gives no rows. Other columns are ignored. Texts of any length are read whole by
    Spark's sha2.
    """
    held = held or {}
    row = leaf([F.col(f"`{c}`") for c in columns])
    claimed = leaf([held.get(c, F.col(f"`{c}`")) for c in columns]) if held else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("-"))  # a null sorts before any value
    leaves = documents.select(key.alias("tree"), F.col(f"`{order}`").alias("id"), row.alias("digest"), claimed.alias("claimed"))
    leaves = written(leaves.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed"))).withColumn("came", F.monotonically_increasing_id()), "leaves")
    forest = Forest.grow(placed(leaves, ["id", "digest", "came"]).drop("came"), fan_out, levels)
    top = Forest.grow(placed(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("branch"), "digest"), ["branch"]), fan_out, levels)

    def to_branch(nodes: pa.Table, found: list[Path], root: str) -> pa.Table:
        more = [f"{d} {root}" for d in nodes.column("digest").to_pylist()]
        return pa.table({"tree": nodes.column("branch"), "path": pa.array(found, pa.list_(pa.string())), "more": more})

    above = top.roots.select("tree", F.array().cast("array<string>").alias("path"), F.col("digest").alias("more"))
    above = written(top.paths(above, to_branch, "tree string, path array<string>, more string"), "branches")

    def to_row(nodes: pa.Table, found: list[Path], more: str) -> pa.Table:
        subroot, root = more.split()
        own = nodes.column("digest").to_pylist()
        folded = [fold(other or d, path) for d, other, path in zip(own, nodes.column("claimed").to_pylist(), found, strict=True)]
        out = {
            "id": nodes.column("id"), "leaf": own, "subroot": [subroot] * len(own), "root": [root] * len(own),
            "proof_sha256": [digest("".join(path)) for path in found], "folded_root": folded, "verified": [x == root for x in folded],
        }
        return pa.table(out | ({"path": pa.array(found, pa.list_(pa.string()))} if with_paths else {}))

    kind = documents.schema[order].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", path array<string>" * with_paths
    return forest.paths(above, to_row, schema).withColumnRenamed("id", order)
