"""Jobs over document tables (set_id, file_name, text). A document set is a partition key everywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..work import counted_side, spread, written


def load_corpus(documents: DataFrame) -> DataFrame:
    """Every file as a row with trimmed text; a failed or empty read stays as a row with empty text."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return documents.select("set_id", "file_name", clean.alias("text"), F.length(clean).cast("long").alias("n_chars"), (F.length(clean) == 0).alias("empty"))


def file_notes(documents: DataFrame) -> DataFrame:
    """(set_id, file_name, n_chars, n_odd, note) with the first note that holds: none, short, noisy or clean."""
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("set_id", "file_name", F.length(text).cast("long").alias("n_chars"), tx.odd_characters(text).alias("n_odd"))
    note = F.when(F.col("n_chars") == 0, "no text").when(F.col("n_chars") < 200, "short").when(F.col("n_odd") / F.col("n_chars") > 0.08, "noisy")
    return sized.withColumn("note", note.otherwise("clean"))


def read_quality(documents: DataFrame) -> DataFrame:
    """Files, characters, odd characters and files by note, for each set."""
    of = lambda note: F.sum(F.when(F.col("note") == note, 1).otherwise(0)).alias(f"n_{note.replace(' ', '_')}")
    return (
        file_notes(documents)
        .groupBy("set_id")
        .agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("chars"), F.sum("n_odd").alias("odd"), *[of(x) for x in ("no text", "short", "noisy", "clean")])
    )


def _spread(documents: DataFrame) -> DataFrame:
    """Texts over all cores, by their names if they have any."""
    by = [c for c in ("file_name",) if c in documents.columns]
    return spread(documents.select("set_id", *by, "text"), *by)


def language_by_script(documents: DataFrame) -> DataFrame:
    """(set_id, n_letters, language, rtl): the script with most letters, earlier in the list on a tie; null under 3 letters."""
    each = tx.letters_by_script(_spread(documents).select("set_id", "text"), "text")
    sums = each.groupBy("set_id").agg(*[F.sum(code).alias(code) for code, _ in tx.SCRIPTS])
    most = F.greatest(*[F.col(code) for code, _ in tx.SCRIPTS])
    pick = F.coalesce(*[F.when(F.col(code) == most, F.lit(code)) for code, _ in tx.SCRIPTS])
    total = sum((F.col(code) for code, _ in tx.SCRIPTS[1:]), F.col(tx.SCRIPTS[0][0]))
    named = sums.select("set_id", total.alias("n_letters"), F.when(total >= 3, pick).alias("language"))
    return named.withColumn("rtl", F.coalesce(F.col("language").isin(*tx.RIGHT_TO_LEFT), F.lit(False)))


LANES = 8  # of 32 bits


def merge_fingerprints(parts: DataFrame) -> DataFrame:
    """(set_id, n_files, fingerprint) of sets from fingerprints of disjoint parts of them, in any number and order.

    A fingerprint is the sum of its entries' SHA-256, taken as eight numbers of 32 bits, so it is added up before the shuffle, needs no
    order, and new files are merged into a set without reading the old ones. Null fingerprints only count.
    """
    lane = lambda i: F.sum(F.conv(F.substring("fingerprint", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"lane_{i}")
    sums = parts.groupBy("set_id").agg(F.sum("n_files").alias("n_files"), *[lane(i) for i in range(LANES)])
    shown = lambda i: F.lower(F.lpad(F.hex(F.pmod(F.coalesce(F.col(f"lane_{i}"), F.lit(0)), F.lit(1 << 32))), 8, "0"))
    return sums.select("set_id", "n_files", F.concat(*[shown(i) for i in range(LANES)]).alias("fingerprint"))


def set_fingerprint(documents: DataFrame) -> DataFrame:
    """(set_id, n_files, fingerprint): independent of order; changes with any name or text, and with how often a file is there.

    See merge_fingerprints: a set of any size is summed in parts. Files without a name count but leave no mark.
    """
    text = F.coalesce("text", F.lit(""))
    entry = F.concat(F.lower(F.col("file_name").cast("string")), F.lit("#"), F.length(text).cast("string"), F.lit(":"), F.sha2(text, 256))
    return merge_fingerprints(documents.select("set_id", F.lit(1).cast("long").alias("n_files"), F.sha2(entry, 256).alias("fingerprint")))


def digest_fingerprint(documents: DataFrame) -> DataFrame:
    """(set_id, n_files, fingerprint): independent of order; changes with any name or text. The SHA-256 of all entries
    in order, where set_fingerprint adds entries up for sets that are merged.

    Entries are hashed to 64 hex digits, sorted, and hashed on as they stream by: no set's list is ever one value.
    SHA-256 takes its input in order, so the digests of one set pass through one task, a batch at a time.
    """
    entry = F.concat(F.lower(F.col("file_name").cast("string")), F.lit("#"), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256))
    hashed = documents.select("set_id", F.sha2(entry, 256).alias("entry"))
    kind = documents.schema["set_id"].dataType.simpleString()
    ordered = hashed.repartition("set_id").sortWithinPartitions("set_id", "entry")
    return ordered.mapInArrow(_digests, f"set_id {kind}, n_files bigint, fingerprint string")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, n_files, fingerprint) of rows (set_id, entry) sorted by both; holds one batch and one hash state. Null entries only count; a set
    of none but these has a null fingerprint."""
    state = None  # set_id (an array of one), files so far, entries so far, hash so far

    def row(set_id: pa.Array, n: int, m: int, sha: Any) -> pa.RecordBatch:
        mark = pa.array([sha.hexdigest() if m else None], pa.string())
        return pa.RecordBatch.from_arrays([set_id, pa.array([n], pa.int64()), mark], ["set_id", "n_files", "fingerprint"])

    for batch in batches:
        ids, lo = batch.column(0), 0
        if not len(ids):
            continue
        for run in pc.run_end_encode(ids).run_ends.to_pylist():
            here = ids.slice(lo, 1)
            if state is None or not state[0].equals(here):
                if state is not None:
                    yield row(*state)
                state = (here, 0, 0, hashlib.sha256())
            at, n, m, sha = state
            entries = batch.column(1).slice(lo, run - lo).drop_null().to_pylist()
            if entries:
                sha.update(("|" * (m > 0) + "|".join(entries)).encode())
            state, lo = (at, n + run - lo, m + len(entries), sha), run
    if state is not None:
        yield row(*state)


def change_verdict(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Per set: reuse, or the first reason against it. Inputs: (set_id, fingerprint, version, provider) and, if both have it, model."""
    models = ["model"] if "model" in current.columns and "model" in cached.columns else []
    old = cached.select("set_id", *[F.col(c).alias(f"old_{c}") for c in ("fingerprint", "version", "provider", *models)], F.lit(True).alias("known"))
    verdict = (
        F.when(F.col("known").isNull(), "nothing cached")
        .when(F.col("fingerprint").isNull(), "removed")
        .when(F.col("old_provider").isNull(), "unknown provider")
        .when(F.col("provider") != F.col("old_provider"), "provider")
        .when(~F.col("model").eqNullSafe(F.col("old_model")) if models else F.lit(False), "model")
        .when(F.col("fingerprint") != F.col("old_fingerprint"), "files changed")
        .when(F.col("version") != F.col("old_version"), "version")
        .otherwise("reuse")
    )
    return current.join(old, "set_id", "full_outer").select("set_id", verdict.alias("verdict"))


def extraction_report(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each file, ordered by set and name: how well it was read (see file_notes) and what was found in it.

    n_facts counts distinct (field, value); fields lists the fields, and by_rule has how many each rule found. Files without candidates
    stay, with none.
    """
    of = lambda rank, name: F.countDistinct(F.when(F.col("rule_rank") == rank, F.col("key"))).alias(name)
    keyed = candidates.where(F.trim("value") != "").select("set_id", F.col("source").alias("file_name"), "field", "rule_rank", F.struct("field", F.lower(F.trim("value"))).alias("key"))
    found = keyed.groupBy("set_id", "file_name").agg(
        F.countDistinct("key").alias("n_facts"), F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"),
        of(4, "labelled"), of(3, "typed"), of(2, "contextual"), of(1, "positional"),
    )
    joined = file_notes(documents).join(found, ["set_id", "file_name"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "labelled", "typed", "contextual", "positional")]
    return joined.select("set_id", "file_name", "n_chars", "note", *counts, F.coalesce("fields", F.lit("")).alias("fields")).orderBy("set_id", "file_name")


def dedupe_keep_first(items: DataFrame, key: Column, seq: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): of rows with one key the first by `seq` stays; rows without a key all stay.

    removed has `duplicate_of`, the seq of the row it repeats. First places are aggregated, not ranked, so a
    key with very many rows is combined before it is shuffled.
    """
    keyed = items.withColumn("_key", key)
    first = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(seq).alias("duplicate_of"))
    joined = keyed.join(first, "_key", "left")
    stays = F.col("_key").isNull() | (F.col(seq) == F.col("duplicate_of"))
    return joined.where(stays).select(*items.columns), joined.where(~stays).select(*items.columns, "duplicate_of")


def coverage_report(items: DataFrame, by: str, kind: str, size: str) -> DataFrame:
    """Counts and sums for every (by, kind), every by, and all: level says which."""
    return (
        items.groupingSets([[F.col(by), F.col(kind)], [F.col(by)], []], F.col(by), F.col(kind))
        .agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.grouping_id().alias("level"))
        .select(F.col(by), F.col(kind), "n", "total", F.col("level").cast("long").alias("level"))
    )


#: Two to four words that begin with a capital, accented ones too.
NAME_SHAPE = r"^[A-ZÀ-Þ][A-Za-zÀ-ÿ'.-]*( [A-ZÀ-Þ][A-Za-zÀ-ÿ'.-]*){1,3}$"


def header_names(documents: DataFrame, lines: int = 8) -> DataFrame:
    """(set_id, file_name, line_no, value): name-shaped lines among the first non-blank ones of each file."""
    split = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = documents.select("set_id", "file_name", F.posexplode(F.slice(split, 1, lines)).alias("line_no", "value"))
    return at.where((F.length("value") <= 60) & F.col("value").rlike(NAME_SHAPE))


def payload_budget(documents: DataFrame, ceiling: int = 18_000_000, named: int = 5) -> DataFrame:
    """(set_id, bytes, encoded, over, largest): encoded size of each set against the ceiling, its largest files named."""
    sized = documents.select("set_id", F.col("file_name").cast("string").alias("file_name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    encoded = F.ceil(F.col("bytes") * 4 / 3).cast("long")
    sums = sized.groupBy("set_id").agg(F.sum("bytes").alias("bytes")).withColumn("encoded", encoded)
    ranked = sized.withColumn("r", F.row_number().over(W.partitionBy("set_id").orderBy(F.desc("bytes"), "file_name"))).where(F.col("r") <= named)
    top = ranked.groupBy("set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "file_name"))), lambda x: x["file_name"]), ",").alias("largest"))
    return sums.join(top, "set_id").select("set_id", "bytes", "encoded", F.greatest(F.col("encoded") - ceiling, F.lit(0)).cast("long").alias("over"), "largest")


def batches(items: DataFrame, by: str, order: str, size: int = 12) -> DataFrame:
    """items with batch_no: chunks of `size` in order within each `by`."""
    return numbered(items, by, order, "_n").withColumn("batch_no", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def numbered(items: DataFrame, by: str, order: str, name: str, pieces: int = 64) -> DataFrame:
    """items with `name`, their row number by `order` within `by`.

    Up to `pieces` values of `order` in each group, those with the smallest hashes, cut it into ranges; ranges are
    numbered apart and moved on by the rows before them. The cuts depend on values only, so every evaluation agrees.
    """
    keys = items.select(F.col(by).alias("_by"), F.col(order).alias("_o")).where(F.col("_o").isNotNull()).distinct()
    keys = keys.withColumn("_r", F.row_number().over(W.partitionBy("_by").orderBy(F.xxhash64("_o"), "_o"))).where(F.col("_r") <= pieces)
    cuts = keys.groupBy("_by").agg(F.collect_list("_o").alias("_cuts"))
    piece = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda x: x <= F.col(order)))
    cut = items.join(cuts, items[by].eqNullSafe(cuts["_by"]), "left").withColumn("_piece", piece).drop("_by", "_cuts")
    sums = cut.groupBy(F.col(by).alias("_b"), F.col("_piece").alias("_p")).count()
    before = F.sum("count").over(W.partitionBy("_b").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_b", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    at = cut.withColumn("_at", F.row_number().over(W.partitionBy(by, "_piece").orderBy(order)))
    out = at.join(sums, at[by].eqNullSafe(sums["_b"]) & (at["_piece"] == sums["_p"]))
    return out.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*items.columns, name)


def grounding_check(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Which claims (claim_id, set_id, value) have all their tokens in their set's texts: (claim_id, grounded, n_missing).

    A claim is grounded if the set's texts hold every token of more than 2 characters as a word; one without such
    tokens, a blank one too, is. Tokens are joined as rows. grounded_values has the other rules.
    """
    norm = claims.select("claim_id", "set_id", tx.plain_words(F.col("value")).alias("value"))
    tokens = norm.select("claim_id", "set_id", F.explode(F.array_distinct(F.split("value", " "))).alias("token")).where(F.length("token") > 2)
    wanted = tokens.select("set_id", "token").distinct()
    held = (
        documents.select("set_id", F.explode(F.array_distinct(F.split(tx.plain_words(F.coalesce("text", F.lit(""))), " "))).alias("token"))
        .join(wanted, ["set_id", "token"], "left_semi")
        .distinct()
        .withColumn("found", F.lit(1))
    )
    seen = tokens.join(held, ["set_id", "token"], "left").groupBy("claim_id").agg(F.count("*").alias("n_tokens"), F.count("found").alias("n_found"))
    return norm.join(seen, "claim_id", "left").select(
        "claim_id",
        (F.coalesce("n_tokens", F.lit(0)) == F.coalesce("n_found", F.lit(0))).alias("grounded"),
        (F.coalesce("n_tokens", F.lit(0)) - F.coalesce("n_found", F.lit(0))).cast("long").alias("n_missing"),
    )


#: Tokens too general to ground a value.
STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "was", "are", "not", "yes", "no", "n/a", "na", "none")


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(parts: DataFrame, wholes: DataFrame, n: int) -> DataFrame:
    """Of parts (set_id, part) those, of n characters or more, that some whole (set_id, whole) of their set contains; distinct.

    A part is looked up by its rarest run of n characters among the wholes of its set, so it meets only wholes that have this run; one with a run that
    no whole has meets none.
    """
    wanted = parts.where(F.length("part") >= n).distinct().withColumn("grams", _grams(F.col("part"), n))
    runs = wanted.select("set_id", F.explode("grams").alias("gram")).distinct()
    held = wholes.distinct().select("set_id", "whole", F.explode(_grams(F.col("whole"), n)).alias("gram")).join(runs, ["set_id", "gram"], "left_semi")
    counts = held.groupBy("set_id", "gram").agg(F.count("*").alias("n"))
    keyed = wanted.select("set_id", "part", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram")).join(counts, ["set_id", "gram"])
    keyed = keyed.groupBy("set_id", "part", "n_grams").agg(F.count("*").alias("known"), F.min(F.struct("n", "gram"))["gram"].alias("gram")).where("known = n_grams")
    return keyed.join(held, ["set_id", "gram"]).where(F.contains("whole", F.col("part"))).select("set_id", "part").distinct()


def grounded_values(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Which claims (claim_id, set_id, value) their set's texts support, by all rules: (claim_id, grounded, missing).

    Grounded is a value that a text contains after normalising; or with 5 digits or more that a text contains when
    both keep digits only; or whose tokens of more than 2 characters, stopwords aside, are all contained in the
    set's texts. missing has the first four tokens that are not. A blank value, and any value of a set without
    text, is not grounded.

    Texts are normalised once, by all tasks; those of sets without claims support none and are not.
    A text that contains a value contains its tokens, so the first rule follows from the third; and a token lies in one word of a text. So tokens
    meet the set's vocabulary, and digits the digits of its texts, by equality or by runs of characters (see contained).
    """
    raw = F.coalesce("value", F.lit(""))
    norm = claims.select("claim_id", "set_id", tx.plain_words(raw).alias("v"), tx.digits_of(raw).alias("d"))
    text = F.coalesce("text", F.lit(""))
    asked = claims.select("set_id").distinct()
    texts = _spread(documents.join(counted_side(asked), "set_id", "left_semi"))
    texts = written(texts.select("set_id", tx.plain_words(text).alias("t"), tx.digits_of(text).alias("td")), "texts").where("t <> ''")  # a filter before would be done where the rows aren't spread yet
    values = norm.where("v <> ''").select("set_id", "v", "d").distinct()
    split = F.filter(F.split("v", " "), lambda x: (F.length(x) > 2) & ~x.isin(*STOPWORDS))
    tokens = values.select("set_id", "v", "d", F.posexplode(split).alias("at", "token"))
    wanted = tokens.select("set_id", F.col("token").alias("part")).distinct()
    vocabulary = texts.select("set_id", F.explode(F.array_distinct(F.split("t", " "))).alias("whole")).where("length(whole) > 2").distinct()
    words = wanted.join(vocabulary.withColumn("part", F.col("whole")), ["set_id", "part"], "left_semi")
    inside = contained(wanted.join(words, ["set_id", "part"], "left_anti"), vocabulary, 3)
    held = words.unionByName(inside).select("set_id", F.col("part").alias("token"))
    absent = tokens.join(held, ["set_id", "token"], "left_anti").groupBy("set_id", "v", "d").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("absent"))
    digits = contained(values.where("length(d) >= 5").select("set_id", F.col("d").alias("part")), texts.where("length(td) >= 5").select("set_id", F.col("td").alias("whole")), 5)
    found = digits.select("set_id", F.col("part").alias("d"), F.lit(True).alias("digits"))
    known = texts.select("set_id", F.lit(True).alias("known")).distinct()
    out = norm.join(found, ["set_id", "d"], "left").join(absent, ["set_id", "v", "d"], "left").join(known, "set_id", "left")
    grounded = (F.col("v") != "") & F.col("known").isNotNull() & (F.col("digits").isNotNull() | F.col("absent").isNull())
    names = F.transform(F.slice(F.coalesce("absent", F.array().cast("array<struct<at:int,token:string>>")), 1, 4), lambda x: x["token"])
    return out.select("claim_id", grounded.alias("grounded"), F.when(grounded, F.array().cast("array<string>")).otherwise(names).alias("missing"))
