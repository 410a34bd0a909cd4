"""Quality rules whose thresholds adapt to each language and source.

Each document gets integer metrics. Per (lang, source) and metric a mergeable quantile sketch is kept: counts
of values by log-linear bucket (exact below 256, then 128 buckets for each power of two, so a quantile is
off by less than 1/128 of its value). Sketches merge by adding counts, in any order, with the same result:
partial aggregation builds them before the shuffle. Quartiles from the sketches give fences
`q3 + spread * (q3 - q1) + slack` (and the mirror image below for word length), which are joined back.
A group's distribution is mixed with its language's, which counts as `prior` documents: a large group decides by itself,
a small one mostly by its language, with no size at which the rule changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_side, space_words, written

#: metric: (slack in the metric's unit, bounded below too)
METRICS = {
    "word_len": (500, True),  # thousandths of a character per word
    "symbols": (200, False),  # ten-thousandths of the word characters
    "dup_lines": (6000, False),  # ten-thousandths of the lines with words
    "repeats": (3000, False),  # ten-thousandths of the words
}


def measures(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(
        "doc_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in documents.columns else F.lit("").alias(c) for c in ("lang", "source")],
        space_words(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    hashes = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("windows"),
    )
    # Only texts with a repeated window are sorted; positions of repeated windows then give the covered words.
    base = base.withColumn(
        "places",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")),
    )
    base = base.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter("places", lambda x, i: (F.get("places", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("places", F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))),
                lambda x: x["p"],
            )
        ),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")),
    )["n"]
    return base.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.cast("long").alias("n_repeat_words"))


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket, from its eight leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over documents that pass the base rules; metric columns as in METRICS."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(each).alias("x"))
        .groupBy("lang", "source", F.col("x.metric").alias("metric"), bucket(F.col("x.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, spread: int = 3, prior: int = 50) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high) for every (lang, source) of the sketch.

    A quartile is the least bucket up to which that share lies of the group's documents and `prior` documents spread like its
    language's. Sketches are a few thousand buckets at most, whatever they count.
    """
    total = F.sum("n").over(W.partitionBy("lang", "metric"))
    wide = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("of_lang", total)
    groups = sketch.select("lang", "source", "metric").distinct()
    every = groups.join(wide, ["lang", "metric"]).join(sketch.withColumnRenamed("n", "own"), ["lang", "source", "metric", "bucket"], "left")
    order = W.partitionBy("lang", "source", "metric").orderBy("bucket")
    upto = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(order)
    size = F.sum(F.coalesce("own", F.lit(0))).over(W.partitionBy("lang", "source", "metric"))
    running = every.select("lang", "source", "metric", "bucket", "of_lang", upto("own").alias("own"), upto("n").alias("all"), size.alias("size"))
    have, need = F.col("own") * F.col("of_lang") + F.col("all") * prior, (F.col("size") + prior) * F.col("of_lang")
    best = running.groupBy("lang", "source", "metric").agg(
        F.min(F.when(have * 4 >= need, F.col("bucket"))).alias("q1"), F.min(F.when(have * 4 >= need * 3, F.col("bucket"))).alias("q3")
    )
    width = (F.col("q3") - F.col("q1")) * spread
    columns = []
    for m, (slack, low) in METRICS.items():
        if low:
            columns.append(F.max(F.when(F.col("metric") == m, F.col("q1") - width - slack)).alias(f"{m}_low"))
        columns.append(F.max(F.when(F.col("metric") == m, F.col("q3") + width + slack)).alias(f"{m}_high"))
    return best.groupBy("lang", "source").agg(*columns)


def judge(documents: DataFrame, spread: int = 3, prior: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts have no words and fail the base rules; null lang or source count as the empty string.
    Repeated rows are judged alike, each counts in the sketches. Other columns are ignored. If no row
    passes the base rules there are no fences and none is kept.
    """
    n = F.col("n_words")
    ratio = lambda a, b, unit: F.when(F.col(b) > 0, F.expr(f"({a} * {unit}L) div {b}")).otherwise(F.lit(0).cast("long"))
    measured = written(
        measures(documents)
        .withColumn("base_failed", (n < 50) | (F.col("n_repeat_words") * 100 > n * 50))
        .withColumns(
            {
                "word_len": ratio("word_chars", "n_words", 1000),
                "symbols": ratio("n_symbols", "word_chars", 10000),
                "dup_lines": ratio("n_dup_lines", "n_lines", 10000),
                "repeats": ratio("n_repeat_words", "n_words", 10000),
            }
        ),
        "measures",
    )
    limits, _ = small_side(written(fences(sketches(measured), spread, prior), "fences"))
    inside = F.lit(True)
    for m, (_, low) in METRICS.items():
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if low:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    return measured.join(limits, ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
