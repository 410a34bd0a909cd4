"""Joins of labels by edit distance, within blocks of any size.

No key finds all pairs whose edit distance may be almost half their length, so labels of a block do meet; but in tiles, and cheap bounds come
first. Both sides of a block are cut into tiles of TILE labels and every pair of tiles is one key of an equality join: no key has more
than two tiles of rows whatever the block's size, and a row is copied once for each tile of the other side. A pair is scored
only if its lengths and its letters allow the similarity, and the score stops at the distance that is too much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..work import sorted_side

#: Labels of one side in a tile.
TILE = 1000
#: Letters are counted for blocks in which a side has more labels than this; in smaller ones a pair's distance is sooner computed.
FEW = 16
#: Blocks with so many pairs at most are assigned in one task each; the others in rounds over all tasks, with the same result.
BLOCK_PAIRS = 100_000

#: Similarities down which `assign_labels` goes.
LEVELS = (0.9, 0.8, 0.7, 0.6)

_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def letter_marks(label: Column) -> list[Column]:
    """Two longs with four bits for each letter, blanks and all else: as many bits of the four are set as the label has of them.

    What one label has more than the other by these marks it has more in truth, so the bits that only one has bound the edit distance.
    """
    counts = F.transform(F.array(*map(F.lit, _LETTERS)), lambda c: F.length(label) - F.length(F.replace(label, c, F.lit(""))))
    counts = F.concat(counts, F.array(F.length(F.translate(label, _LETTERS, ""))))
    pack = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda bits, n: F.shiftleft(bits, 4).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(4))) - 1))
    return [pack(F.slice(counts, 1, 14)), pack(F.slice(counts, 15, 14))]


def _sides(df: DataFrame, x: str) -> DataFrame:
    """Distinct cleaned labels of a side."""
    labels = df.select("block", tx.cleaned(F.col("label")).alias(f"l{x}")).where(f"l{x} <> ''").distinct()
    return labels.select("block", f"l{x}", F.length(f"l{x}").alias(f"n{x}"))


def similar_labels(left: DataFrame, right: DataFrame, least: float, same: bool = False, tile: int = TILE) -> DataFrame:
    """(block, la, lb, score): distinct cleaned labels of both sides in one block with similarity of at least `least`.

    With `same` the sides are one table, and of two labels only the pair with la <= lb is given. Blank labels and null blocks have no pairs.
    """
    a, b = _sides(left, "a"), _sides(right, "b")
    sizes = lambda df, name: df.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > min(FEW, tile)).select("block", F.ceil(F.col("n") / tile).cast("int").alias(name))

    def tiled(df: DataFrame, x: str, own: DataFrame, other: DataFrame) -> DataFrame:
        """Its own tile by hash, one row for each tile of the other side, and the label's marks (null in blocks of few labels)."""
        many = lambda c: F.coalesce(c, F.lit(1))
        out = df.join(own, "block", "left").join(other, "block", "left")
        mine = F.pmod(F.xxhash64(f"l{x}"), many(F.col(f"tiles_{x}"))).cast("int")
        y = "b" if x == "a" else "a"
        listed = F.col("tiles_a").isNotNull() | F.col("tiles_b").isNotNull()
        marks = [F.when(listed, m).alias(f"{x}{i}") for i, m in enumerate(letter_marks(F.col(f"l{x}")))]
        return out.select(*df.columns, mine.alias(f"t{x}"), *marks, F.explode(F.sequence(F.lit(0), many(F.col(f"tiles_{y}")) - 1)).alias(f"t{y}"))

    # only blocks of more than FEW labels are listed
    sa, sb = sizes(a, "tiles_a"), sizes(b, "tiles_b")
    # A tile is few bytes and much work, so partitions aren't merged by their size: the number is given.
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "ta", "tb")
    met = spread(tiled(a, "a", sa, sb)).join(sorted_side(spread(tiled(b, "b", sb, sa))), ["block", "ta", "tb"])
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in (0, 1)), F.lit(0))
    # round(1 - edits / longer, 6) >= least
    edits = f"cast(floor(greatest(na, nb) * {1 - least + 5e-7!r}D + 1e-9D) as int)"
    near = (F.abs(F.col("na") - F.col("nb")) <= F.expr(edits)) & F.coalesce(F.greatest(only("a", "b"), only("b", "a")) <= F.expr(edits), F.lit(True))
    if same:
        near = near & (F.col("la") <= F.col("lb"))
    # As a case: of conditions joined by "and" the optimizer might put the dear one first.
    met = met.where(F.when(near, F.expr(f"levenshtein(la, lb, {edits})")) >= 0)
    return met.select("block", "la", "lb", F.round(1 - F.levenshtein("la", "lb") / F.greatest("na", "nb"), 6).alias("score"))


def label_pairs(left: DataFrame, right: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(block, a, b, score): ids of labels (block, id, label) of both sides in one block with similarity of at least `least`."""
    side = lambda df, x: df.select("block", F.col("id").alias(x), tx.cleaned(F.col("label")).alias(f"l{x}"))
    pairs = similar_labels(left, right, least, tile=tile)
    return pairs.join(sorted_side(side(left, "a")), ["block", "la"]).join(sorted_side(side(right, "b")), ["block", "lb"]).select("block", "a", "b", "score")


def equal_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, a, b, score): what the greedy order of `assign` takes of the pairs of equal cleaned labels: ids of each label in order, side by side."""

    def side(df: DataFrame, x: str) -> DataFrame:
        labels = df.select("block", F.col("id").alias(x), tx.cleaned(F.col("label")).alias("l")).where("l <> ''")
        return labels.withColumn("_n", F.row_number().over(W.partitionBy("block", "l").orderBy(x)))

    return side(left, "a").join(sorted_side(side(right, "b")), ["block", "l", "_n"]).select("block", "a", "b", F.lit(1.0).alias("score"))


def assign_labels(left: DataFrame, right: DataFrame, least: float, keep: Callable[[DataFrame], DataFrame], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """assign(label_pairs(left, right, least)), for ids (block, id, label) that are unique in their block and side.

    The greedy order takes high scores first, so it goes down in levels: equal labels, then pairs of at least each level among the ids that
    are still free. Pairs of a level are made only of those, not of all that resemble each other at all.
    """
    taken, sides = [keep(equal_pairs(left, right))], [left, right]
    for level in [*(x for x in levels if x > least), least]:
        for i, x in enumerate("ab"):
            gone = taken[-1].select("block", F.col(x).alias("id"))
            sides[i] = keep(sides[i].join(sorted_side(gone), ["block", "id"], "left_anti"))
        taken.append(keep(assign(label_pairs(*sides, level), keep)))
    return reduce(DataFrame.unionByName, taken)


def fuzzy_pairs(labels: DataFrame, threshold: float = 0.8, tile: int = TILE) -> DataFrame:
    """Pairs (a, b, score), a < b, of labels (id, block, label) in one block with similarity of at least `threshold`."""
    pairs = similar_labels(labels, labels, threshold, same=True, tile=tile)
    side = lambda x: labels.select("block", F.col("id").alias(x), tx.cleaned(F.col("label")).alias(f"l{x}"))
    found = pairs.join(sorted_side(side("a")), ["block", "la"]).join(sorted_side(side("b")), ["block", "lb"])
    found = found.where((F.col("la") < F.col("lb")) | (F.col("a") < F.col("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def assign(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Greedy one-to-one assignment of pairs (block, a, b, score): highest score first, smaller a then b on ties.

    Blocks of few pairs are gone through in that order as they stream by, each in one task. In others every round takes the pairs that are best for both
    sides, which is what the greedy order would take, and drops all others of either side; `keep` writes a round's tables. There are as many rounds
    as the longest chain of pairs that each share a side with the next and fall in that order.
    """
    pairs = keep(pairs.select("block", "a", "b", "score"))
    large = keep(pairs.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_pairs).select("block"))
    small = pairs.join(large, "block", "left_anti").repartition("block").sortWithinPartitions("block", F.desc("score"), "a", "b")
    taken, left = [keep(small.mapInArrow(_greedy, pairs.schema))], keep(pairs.join(large, "block", "left_semi"))
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    while not left.isEmpty():
        by_a = left.groupBy("block", "a").agg(F.min(order).alias("x")).select("block", "a", F.col("x.b").alias("b"))
        by_b = left.groupBy("block", "b").agg(F.min(order).alias("x")).select("block", F.col("x.a").alias("a"), "b")
        now = keep(left.join(by_a, ["block", "a", "b"]).join(by_b, ["block", "a", "b"]).select("block", "a", "b", "score"))
        taken.append(now)
        left = keep(left.join(now.select("block", "a"), ["block", "a"], "left_anti").join(now.select("block", "b"), ["block", "b"], "left_anti"))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by block and in the greedy order those whose sides are free when they come."""
    block, used_a, used_b = None, set(), set()
    for batch in batches:
        free = []
        for at, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b")), strict=True):
            if at != block:
                block, used_a, used_b = at, set(), set()
            free.append(a not in used_a and b not in used_b)
            if free[-1]:
                used_a.add(a)
                used_b.add(b)
        yield batch.filter(pa.array(free, pa.bool_()))
