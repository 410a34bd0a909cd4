"""How filters interact, in every order, from relations of the ids that fail each of them.

Each filter's failing ids are stored as a table of their own. What a filter removes after others is a left-semi join of those
that are left with its table, what is left after it a left-anti join. Whether a row is left after a prefix depends on the set of filters in it
and not on their order, so the joins go down one order only and keep both sides: each filter splits every relation that the
filters before it made in two, those relations are told apart by the filters that their ids fail, and the survivors and the removals of every
prefix of every order are unions of some of them. That is one semi and one anti join for each filter over ids that fail any, where a pair of joins for
each of the prefixes would be 2 ** n times as many.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import space_words, written

#: In place of a rule: rows fail whose text a row with a smaller doc_id has, anywhere in the table.
REPEATED = object()

#: Failure conditions of a text, its words and how many they are, by letter.
RULES: dict[str, object] = {
    "A": lambda text, words, n: n < 200,
    "B": lambda text, words, n: 100 * F.size(F.array_distinct(words)) < 50 * n,
    "C": lambda text, words, n: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words, n: text.rlike("[#$%&*|]"),
    "E": REPEATED,
}


def failing(documents: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows as (row, doc_id, part), numbered; and a stored table (row) of those that fail each rule."""
    text = F.coalesce("text", F.lit(""))
    own = {k: f for k, f in rules.items() if f is not REPEATED}
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), space_words(text).alias("words"))
    marks = [f(F.col("text"), F.col("words"), F.size("words")).alias(f"fails_{k}") for k, f in own.items()]
    key = [F.unhex(F.sha2("text", 256)).alias("text_key")] if len(own) < len(rules) else []
    rows = written(rows.select("doc_id", "part", *key, *marks).withColumn("row", F.monotonically_increasing_id()), "measured")
    tables = {}
    for k, f in rules.items():
        found = rows.where(f"fails_{k}") if f is not REPEATED else _repeated(rows)
        tables[k] = written(found.select("row"), f"fails-{k}")
    return rows.select("row", "doc_id", "part"), tables


def _repeated(rows: DataFrame) -> DataFrame:
    """Only texts that several doc_ids have are joined back, each as one row; AQE splits the rows of a text with very many."""
    several = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return rows.join(several.select("text_key", "first"), "text_key").where("doc_id > first")


def classes(documents: DataFrame, rules: dict[str, object], labels: DataFrame) -> DataFrame:
    """Disjoint id relations of all failing rows, counted: (part, fails, n, good, toxic), and for each part a row (part, '', total).

    fails has the letters of the filters that the rows fail, in their given order.
    """
    rows, tables = failing(documents, rules)
    any_fails = tables[next(iter(rules))]
    for k in list(rules)[1:]:
        any_fails = any_fails.unionByName(tables[k])
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    left = rows.join(any_fails, "row", "left_semi").join(marks, "doc_id", "left")
    left = written(left.select("row", "part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.lit("").alias("fails")), "left")
    for k, table in tables.items():
        removed = left.join(table, "row", "left_semi").withColumn("fails", F.concat("fails", F.lit(k)))
        left = written(removed.unionByName(left.join(table, "row", "left_anti")), f"after-{k}")
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    none = F.lit(0).cast("long")
    counted = left.groupBy("part", "fails").agg(F.count("*").alias("n"), one("good"), one("toxic")).withColumn("total", none)
    totals = rows.groupBy("part").agg(F.count("*").alias("total"))
    return counted.unionByName(totals.select("part", F.lit("").alias("fails"), none.alias("n"), none.alias("good"), none.alias("toxic"), "total"))


def audit(documents: DataFrame, rules: dict[str, object], labels: DataFrame) -> DataFrame:
    """One row for each part (value of lang, null as ''), order of all filters and step; zeros included.

    kept: rows left after the step; removed: by its filter; redundant: rows that fail its filter and were removed earlier; unique_fails: rows that
    fail no other; good_lost and toxic_lost: removed rows whose doc_id has a label quality = 1, toxic = 1; shapley: removed, summed over all orders.
    There are k! * k rows a part, so k, the number of rules, is small.

    Null texts are empty. Repeated rows count each, also under one doc_id; a null doc_id has no label, is not smaller than any and never fails REPEATED.
    Of several labels of a doc_id one that is 1 is enough. An empty table has no parts and so no rows. Other columns are ignored. Texts are read
    whole.
    """
    if any(len(k) != 1 for k in rules):
        raise ValueError("filters are named by one letter each")
    letters = sorted(rules)
    pairs = [("".join(before), f) for n in range(len(letters)) for f in letters for before in combinations([x for x in letters if x != f], n)]
    weight = lambda before: factorial(len(before)) * factorial(len(letters) - 1 - len(before))
    steps = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("letter"), F.lit(weight(b)).cast("long").alias("orders")) for b, f in pairs]))
    met = F.expr("translate(fails, before, '') <> fails")
    fails = F.expr("contains(fails, letter)")
    total = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    cells = classes(documents, rules, labels).select("*", steps.alias("at")).select("*", "at.*").groupBy("part", "before", "letter", "orders").agg(
        (F.sum("total") - F.sum(F.when(met | fails, F.col("n")).otherwise(0))).alias("kept"), total(fails & ~met, "n", "removed"), total(fails & met, "n", "redundant"),
        total(F.col("fails") == F.col("letter"), "n", "unique_fails"), total(fails & ~met, "good", "good_lost"), total(fails & ~met, "toxic", "toxic_lost"),
    )
    shares = cells.groupBy("part", "letter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    spark = documents.sparkSession
    listed = [("".join(o), i + 1, "".join(sorted(o[:i])), o[i]) for o in permutations(letters) for i in range(len(o))]
    orders = spark.createDataFrame(listed, "filter_order string, step int, before string, letter string")  # as many as filters allow, whatever the data
    return cells.join(shares, ["part", "letter"]).join(F.broadcast(orders), ["before", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
