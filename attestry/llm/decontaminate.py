"""Benchmark decontamination: a prefix-filtered set join that verifies whole windows of words.

Every window of an item (`window` consecutive words; an item with fewer words is one window) is a set of
word shingles that a document must contain whole. One scan of the documents keeps the shingles that occur
in some window. Counted over all documents they give the rarity order; with containment of 1 the necessary
prefix of a window is its one rarest shingle. Only occurrences of prefix shingles become candidates, which
must pass the positional bound (the window starts inside the text) and the length bound (it ends inside)
before the window's words are compared one by one with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, alnum_words, small_side, written


def _shingle(words: str, at: Column, k: int) -> Column:
    """Hash of the k words from position `at`; k is part of the hash."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), at + i) for i in range(k)])


def _text_key(text: Column) -> Column:
    """With doc_id, tells rows apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct (item_id, win array, wid). Items with a null id or without words have none."""
    words = benchmark.where(F.col("item_id").isNotNull()).select("item_id", alnum_words(F.col("text")).alias("words"))
    n = F.size("words")
    return (
        words.where(n > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("at"))
        .select("item_id", F.slice("words", F.col("at"), F.least(F.lit(window), n)).alias("win"))
        .distinct()
        .withColumn("wid", F.sha2(F.concat_ws(" ", "win"), 256))
    )


def hits(
    documents: DataFrame, benchmark: DataFrame, window: int, shingle_words: int, broadcast_rows: int = BROADCAST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has (doc_id, text_key, n_words) for each input row; found has
    (doc_id, text_key, n_hit, items) for each distinct (doc_id, text) that holds a window."""
    by_item = written(item_windows(benchmark, window), "windows")
    wins = by_item.select("wid", "win").distinct()
    k_of = F.least(F.lit(shingle_words), F.size("win"))
    sizes = sorted(r[0] for r in wins.select(k_of).distinct().collect())  # at most shingle_words values
    parts = wins.select("wid", "win", k_of.alias("k"), F.explode(F.sequence(F.lit(0), F.size("win") - k_of)).alias("off"))
    key = F.lit(None).cast("long")
    for k in sizes:
        key = F.when(F.col("k") == k, _shingle("win", F.col("off"), k)).otherwise(key)
    parts = parts.withColumn("key", key)
    known, _ = small_side(parts.select(F.col("key").alias("known")).distinct(), broadcast_rows)

    tokens = documents.select("doc_id", "text", _text_key(F.col("text")).alias("text_key"), alnum_words(F.col("text")).alias("words"))
    at = tokens.select(
        "doc_id", "text_key", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word")
    )
    keys = [F.when(F.col("pos") + k <= F.size("words"), _shingle("words", F.col("pos"), k)) for k in sizes]
    if len(keys) > 1:
        at = at.select("*", F.posexplode(F.array(*keys)).alias("nth", "key"))
    else:
        at = at.select("*", F.lit(0).alias("nth"), (keys[0] if keys else F.lit(None).cast("long")).alias("key"))
    first = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("nth") == 0)
    seen = written(
        at.select("doc_id", "text_key", "n_words", "pos", "key", first.alias("first"))
        .join(known, F.col("key") == F.col("known"), "left")
        .where(F.col("first") | F.col("known").isNotNull())
        .select("doc_id", "text_key", "n_words", "first", "pos", F.col("known").alias("key")),
        "shingles",
    )
    rows = seen.where("first").select("doc_id", "text_key", "n_words")
    seen = seen.where(F.col("key").isNotNull()).select("doc_id", "text_key", "n_words", "pos", "key").distinct()

    counts = seen.groupBy("key").count()
    prefix = (
        parts.join(counts, "key")  # a window with a shingle that never occurs can't occur itself
        .groupBy("wid", "win", "k")
        .agg(F.count("*").alias("have"), F.min(F.struct("count", "off", "key")).alias("least"))
        .where(F.col("have") == F.size("win") - F.col("k") + 1)
        .select("wid", "win", F.col("least.off").alias("off"), F.col("least.key").alias("key"))
    )
    prefix, _ = small_side(written(prefix, "prefixes"), broadcast_rows)
    start = F.col("pos") - F.col("off")
    near = (
        seen.join(prefix, "key")
        .where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
        .select("doc_id", "text_key", "wid", "win", start.alias("start"))
    )
    near = written(near, "candidates")
    held, _ = small_side(near.select("doc_id", "text_key").distinct(), broadcast_rows)
    texts = documents.select("doc_id", "text", _text_key(F.col("text")).alias("text_key"))
    texts = texts.join(held.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), alnum_words(F.col("text")).alias("words"))
    spans = (
        near.groupBy("doc_id", "text_key")  # as many windows as one document has places
        .agg(F.collect_set(F.struct("start", "win", "wid")).alias("near"))
        .join(texts.dropDuplicates(["d", "t"]), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        .select(
            "doc_id",
            "text_key",
            F.expr("filter(near, x -> slice(words, x.start + 1, size(x.win)) = x.win)").alias("near"),
        )
        .where(F.size("near") > 0)
    )
    spans = written(
        spans.select(
            "doc_id",
            "text_key",
            F.array_sort(F.transform("near", lambda x: F.struct(x["start"].alias("a"), (x["start"] + F.size(x["win"])).alias("b")))).alias("spans"),
            F.array_distinct(F.transform("near", lambda x: x["wid"])).alias("wids"),
        ),
        "spans",
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).cast("int").alias("end"),
            (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).cast("long").alias("n"),
        ),
    )["n"]
    items = (
        spans.select("doc_id", "text_key", F.explode("wids").alias("wid"))
        .join(by_item.select("wid", "item_id"), "wid")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    )
    found = (
        spans.select("doc_id", "text_key", covered.alias("n_hit"))
        .join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        .select("doc_id", "text_key", "n_hit", "items")
    )
    return rows, found


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle_words: int = 5, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of any window. Null and empty texts have no words and no
    hits. Repeated rows give repeated results; equal ids with other texts are judged apart. Other columns
    are ignored. An empty benchmark leaves all documents clean. Tables of windows, prefixes and candidate
    documents are broadcast only if they have at most `broadcast_rows` rows; otherwise the joins shuffle.
    """
    rows, found = hits(documents, benchmark, window, shingle_words, broadcast_rows)
    found = found.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size(F.when(F.col("items").isNotNull(), F.col("items"))), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(names, F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle_words: int = 5) -> DataFrame:
    """documents without the rows whose text holds any window of any item; all columns as they were."""
    _, found = hits(documents, benchmark, window, shingle_words)
    found, _ = small_side(written(found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")), "contaminated"))
    same = documents["doc_id"].eqNullSafe(found["_d"]) & (_text_key(documents["text"]) == found["_t"])
    return documents.join(found, same, "left_anti")
