"""Line dedup by an exact set-similarity join.

A line's set holds its distinct words (or, with `shingle_words` over 1, its distinct shingles of so many words; a
line with fewer is one shingle). Lines with equal sets collapse first. A line with words is removed if an
earlier line, by (doc_id, line number), has an equal or similar set.

Rarity. The documents that hold a token are counted for every token (lines, for shingles). The RANKED most frequent
tokens are ordered by their counts, ties by hash; all others come before them, by hash. (So do the few whose place in the table of
ranks a more frequent token holds.) Tokens of a set are sorted by that order. Any total order gives the same result;
this one keeps frequent tokens out of prefixes, and neighbours below are rare without a finer one.

Prefix. Sets of na and nb tokens with similarity t share o >= t (na + nb) / (1 + t) tokens, so that d = na + nb - 2 o
are in one of both only. These d cut the shared tokens, taken in order, into d + 1 runs at most: of any 2 d + 3
shared tokens some three are neighbours in both sets. The first 2 d + 3 shared tokens stand among the first
(na - o) + 2 d + 3 <= 3 na (1 - t) + 3 of a set. So similar sets that share as many have three neighbours within that prefix in
common, and such threes are the join keys. Only small sets may share fewer (at 0.8 those of 4 and 5 tokens): of d + 2 shared tokens two are neighbours, within
the first 2 na (1 - t) + 2 of a set, so those of `small_sets` tokens or less have pairs for keys too. A single token would do with a shorter
prefix, but the number of lines that share one frequent-enough token grows with the input, and their pairs with its square; so does, later, that of
lines which share two neighbours. Sets too small to resemble an unequal one have no keys.

Pairs. Each key's sets meet one set of the key, its hub: that which most lines have (by powers of two), since what
copies were made of is near to all of them, while two copies may each have their own changes. Sets that no hub removed meet a
second hub, the earliest other set of the key. Those that are still there meet the earlier sets of their keys, once for each run of neighbouring keys that both have: at a key whose predecessor in both sets is the
same key they have met already. Pairs must pass the length bound, the positional bound, and a parity bound (sets differ in at
least as many tokens as parities of hashed tokens do) before whole sets are compared. Keys of very many
sets are set apart so that no task gathers them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, forget, fresh, release, small_side, written

#: So many tokens at most have a rank of their own, in a table that every task holds.
RANKED = (1 << 12) - 1
_SLOTS, _RANK_BITS = 1 << 14, 12
#: Bits of a number that tell sets apart (partition and row), of a position, and the largest position; the rest orders sets by their lines.
SET_BITS, PLACE_BITS, MAX_PLACE, _CLASSES = 52, 7, (1 << 7) - 1, 15
#: Sets of more tokens spread their parities over two numbers.
LARGE = 100
#: A key that this part of a sample of all sets shares is set apart. There are at most HOT_PART * keys a set of them.
HOT_PART, _SAMPLE = 256, 64


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _plain(text: Column) -> Column:
    """Text whose words are split by spaces and line ends only. Few texts hold other white space and need a pattern."""
    return F.when(text.rlike("[\\x09\\x0B-\\x0D]"), F.regexp_replace(text, "[\\x09\\x0B-\\x0D]", " ")).otherwise(text)


def line_words(line: Column) -> Column:
    """Words of a plain line. Only a space at an end or beside another leaves empty ones to remove."""
    words = F.split(line, " ")
    return F.when(F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  ")) | (line == ""), F.array_remove(words, "")).otherwise(words)


def _split(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line: a row for each plain line."""
    # (keyed first: what stands beside the generator is computed, and the text carried, for each line)
    keyed = documents.select("doc_id", _text_key(F.col("text")).alias("text_key"), _plain(F.col("text")).alias("plain"))
    return keyed.select("doc_id", "text_key", F.posexplode(F.split("plain", "\n")).alias("line_no", "line"))


def _once(array: Column) -> Column:
    """A generated column, so that the array is made once a row and not again for each element of a function that uses it."""
    return F.explode(F.array(array))


def _hashes(words: str, shingle_words: int) -> Column:
    """Hashes of the tokens of an array of words."""
    if shingle_words == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    count = F.greatest(F.size(words) - shingle_words + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(shingle_words)]))


def rank_table(hashes: list[int]) -> list[int]:
    """A table of _SLOTS entries in which the token hashes[r - 1] has rank r: its slot, the lowest bits of its hash, holds the
    hash with the rank in the lowest bits. Of tokens of one slot the last, most frequent one stays."""
    table = [0] * _SLOTS
    for rank, h in enumerate(hashes, 1):
        table[h & (_SLOTS - 1)] = (h >> _RANK_BITS << _RANK_BITS) | rank
    return table


def _ranks(docs: DataFrame, shingle_words: int) -> Column:
    """The rank table of the RANKED most frequent tokens of all lines, as a column of one array."""
    plain = _plain(F.col("text"))
    if shingle_words == 1:
        words = F.split(F.replace(plain, F.lit("\n"), F.lit(" ")), " ")
        tokens = docs.select(F.explode(F.array_distinct(words)).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("h"))
    else:
        at = docs.select(F.explode(F.split(plain, "\n")).alias("line")).select(line_words(F.col("line")).alias("words"))
        tokens = at.where(F.size("words") > 0).select(F.explode(F.array_distinct(_hashes("words", shingle_words))).alias("h"))
    top = tokens.groupBy("h").count().orderBy(F.desc("count"), "h").limit(RANKED)
    hashes = [r["h"] for r in top.select("h").collect()][::-1]  # RANKED numbers at most
    release(docs.sparkSession)
    return F.from_json(F.lit(json.dumps(rank_table(hashes))), "array<bigint>")  # a constant, read once


def _codes(hashes: str, table: Column) -> Column:
    """The distinct tokens as sorted codes, rarest first: rank in the upper bits (0: none), the hash's upper bits below."""

    slot, low = F.lit(_SLOTS - 1).cast("long"), F.lit((1 << _RANK_BITS) - 1).cast("long")

    def coded(h: Column) -> Column:
        entry = F.get(table, h.bitwiseAND(slot).cast("int"))
        bare = F.shiftrightunsigned(h, _RANK_BITS + 1)  # (the sign stays free)
        ranked = bare.bitwiseOR(F.shiftleft(entry.bitwiseAND(low), 63 - _RANK_BITS))
        return F.when(F.shiftright(entry.bitwiseXOR(h), _RANK_BITS) == 0, ranked).otherwise(bare)

    return F.sort_array(F.transform(F.array_distinct(hashes), coded))


def _coded(lines: DataFrame, table: Column, shingle_words: int) -> DataFrame:
    """lines that have words, with their `codes` in place of `line`."""
    at = lines.where(F.trim("line") != "").withColumn("words", line_words(F.col("line")))
    return at.withColumn("hashes", _hashes("words", shingle_words)).withColumn("codes", _codes("hashes", table)).drop("line", "words", "hashes")


def _overlap(percent: int) -> Column:
    """Least number of tokens that similar sets of na and nb have in common."""
    return F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100.0 + percent) - F.lit(1e-9))


def _parities(codes: str) -> list[Column]:
    """Whether an odd number of codes falls on each of 64 places: v0 by six bits of them; v1 by six others, or for large sets by the first six, over half the codes."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    mask = lambda n: F.lit(n).cast("long")
    flip = lambda place: lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", one, place(h).bitwiseAND(mask(63)).cast("int")))
    first = flip(lambda h: h)
    half = F.filter(codes, lambda h: h.bitwiseAND(mask(64)) != 0)
    v1 = F.when(F.size(codes) > LARGE, F.aggregate(half, none, first)).otherwise(F.aggregate(codes, none, flip(lambda h: F.shiftright(h, 6))))
    return [F.aggregate(codes, none, first).alias("v0"), v1.alias("v1")]


def _may_match(percent: int) -> Column:
    """Length bound; and parity bound: no more differences than the sizes allow, by either number, or for large sets by both halves' sum."""
    sized = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    v0, v1 = F.col("v0a").bitwiseXOR(F.col("v0b")), F.col("v1a").bitwiseXOR(F.col("v1b"))
    apart = (
        F.when(F.least("na", "nb") > LARGE, F.bit_count(v0.bitwiseXOR(v1)) + F.bit_count(v1))
        .when(F.greatest("na", "nb") > LARGE, F.bit_count(v0))
        .otherwise(F.greatest(F.bit_count(v0), F.bit_count(v1)))
    )
    return sized & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _in_place(percent: int) -> Column:
    """Positional bound: no more in common than the neighbours and what lies before and after them."""
    most = F.least("pa", "pb") + 2 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 2
    return (most >= _overlap(percent)) | (F.greatest("pa", "pb") >= MAX_PLACE)


def small_sets(percent: int) -> int:
    """Sets of more tokens than this have 2 d + 3 tokens in common with every similar one: o >= d t / (1 - t) leaves o < 2 d + 3 to few d."""
    most = 2 * (100 - percent) // (3 * percent - 200)
    return 3 * most + 2 if most else 0


def _with_keys(sets: DataFrame, percent: int) -> DataFrame:
    """The columns of sets (n, prefix, others) that have keys, with p and key of each: a row for each three neighbours of the prefix, and of small sets for each two."""
    threes = F.transform(F.sequence(F.lit(0), F.size("prefix") - 3), lambda i: F.struct(F.least(i, F.lit(MAX_PLACE)).alias("p"), _key_at(i).alias("key")))
    # Keys of two have no place: they don't bound what sets have in common.
    two = lambda i: F.struct(F.lit(MAX_PLACE).alias("p"), F.xxhash64(F.get("prefix", i), F.get("prefix", i + 1)).alias("key"))
    twos = F.transform(F.sequence(F.lit(0), F.least(F.size("prefix"), F.floor(F.col("n") * (200 - 2 * percent) / F.lit(100.0) + F.lit(1e-9)).cast("int") + 2) - 2), two)
    able = sets.where((F.col("n") * (100 - percent) >= percent) & (F.size("prefix") > 2))
    keyed = able.withColumn("at", F.explode(F.when(F.col("n") <= small_sets(percent), F.concat(threes, twos)).otherwise(threes)))
    return keyed.select(*sets.columns, "at.p", "at.key")


def _key_at(i: Column) -> Column:
    return F.xxhash64(*[F.get("prefix", i + j) for j in range(3)])


def decisions(documents: DataFrame, shingle_words: int = 1, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Lines to remove: (doc_id, text_key, dropped array of line numbers), a row for each document with any.

    Null texts have no lines. Lines without words stay. Of repeated rows each loses the same lines. The
    order of documents is that of doc_id, null first; equal ids with other texts tie by their sets. Texts and lines may
    be of any length; other columns are ignored. `percent` is 70 or more (below, the bounds of prefixes do not hold).
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent from 70 to 100")
    docs = documents.select("doc_id", "text")
    table = _ranks(docs, shingle_words)
    n = F.size("codes")
    reach = F.floor(n * (300 - 3 * percent) / F.lit(100.0) + F.lit(1e-9)).cast("int") + 3
    wide = written(
        _coded(_split(docs), table, shingle_words).select(
            "doc_id", "text_key", "line_no", n.alias("n"), F.xxhash64("codes").alias("k1"), F.hash("codes").alias("k2"), *_parities("codes"),
            # Neighbours are hashed in threes later; here 32 bits of each token are enough.
            F.transform(F.slice("codes", 1, reach), lambda c: F.hash(c)).alias("prefix"),
        ),
        "wide-lines",
    )
    lines = written(wide.select("doc_id", "text_key", "line_no", "k1", "k2"), "lines")
    place = F.struct(F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    sets = wide.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in ("n", "v0", "v1", "prefix")])
    rare = _CLASSES - F.least(F.length(F.bin("lines")), F.lit(_CLASSES))  # 0 for the sets that most lines have
    sets = written(sets.withColumn("rare", rare).drop("lines").withColumn("sid", F.monotonically_increasing_id()), "line-sets")
    forget(wide)
    release(docs.sparkSession)

    def keys(some: DataFrame) -> DataFrame:
        # Rarity, position and set share a number, for narrow rows; the least of a key is its hub. A position beyond the limit has no bound.
        rows = _with_keys(some.select("sid", "rare", "n", "prefix"), percent)
        high = F.shiftleft(F.col("rare"), PLACE_BITS).bitwiseOR(F.col("p"))
        return rows.select("key", F.shiftleft(high.cast("long"), SET_BITS).bitwiseOR(F.col("sid")).alias("set_place"))

    sid = F.col("set_place").bitwiseAND(F.lit((1 << SET_BITS) - 1).cast("long"))
    place_of = F.shiftright("set_place", SET_BITS).bitwiseAND(F.lit(MAX_PLACE).cast("long"))

    sampled = sets.where(F.pmod("k1", F.lit(_SAMPLE)) == 0)
    least = max(64, sampled.count() // HOT_PART)
    hot = written(keys(sampled).groupBy("key").count().where(F.col("count") >= least).select("key"), "hot-keys")
    by_key = W.partitionBy("key")
    met = keys(sets)
    if any_hot := not hot.isEmpty():
        hot, _ = small_side(hot, broadcast_rows)
        met = met.join(hot, "key", "left_anti")
    # A key stands once in a set, so that two rows of it are two sets.
    met = met.select("*", F.min("set_place").over(by_key).alias("first_row"), F.count("*").over(by_key).alias("size")).where("size > 1")
    if any_hot:
        hot_rows = written(keys(sets).join(hot, "key", "left_semi"), "hot-rows")
        hubs, _ = small_side(hot_rows.groupBy("key").agg(F.min("set_place").alias("first_row"), F.count("*").alias("size")).where("size > 1"), broadcast_rows)
        met = met.unionByName(hot_rows.join(hubs, "key").select("key", "set_place", "first_row", "size"))
    hub = F.col("first_row").bitwiseAND(F.lit((1 << SET_BITS) - 1).cast("long"))
    met = written(met.select("key", sid.alias("sid"), place_of.cast("int").alias("p"), hub.alias("hub"), "size"), "keys")
    release(docs.sparkSession)

    facts = sets.select("sid", "n", "v0", "v1", F.struct("first", "k1", "k2", "sid").alias("at"))
    named = lambda df, x, key: df.select(*key, *[F.col(c).alias(f"{c}{x}") for c in df.columns if c not in key])

    def losers(pairs: DataFrame, label: str) -> DataFrame:
        """Of pairs (ata, atb) of sets, the later ones of those that are similar: sid."""
        pairs = written(pairs.select(F.least("ata", "atb").alias("ata"), F.greatest("ata", "atb").alias("atb")).distinct(), f"{label}-pairs")
        need = pairs.select(F.col("ata").alias("at")).unionByName(pairs.select(F.col("atb").alias("at"))).distinct()
        # Only documents whose lines stand for the sets in question are split again.
        wanted = need.groupBy(F.col("at.first.d").alias("d")).agg(F.collect_list("at").alias("wanted"))
        wanted, _ = small_side(written(wanted, f"{label}-wanted"), broadcast_rows)
        rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).select("wanted", _once(F.split(_plain(F.col("text")), "\n")).alias("all"))
        rows = rows.select(F.explode(F.transform("wanted", lambda x: F.struct(x.alias("at"), F.get("all", x["first"]["l"]).alias("line")))).alias("x"))
        rows = rows.select("x.*").where("line is not null")  # (another text of that id may have fewer lines)
        # (once: a condition on them would have the codes made anew for each of its parts, and the table of ranks in the plan as often)
        known = _coded(rows, table, shingle_words).select("at", _once(F.col("codes")).alias("codes"))
        known = known.where((F.xxhash64("codes") == F.col("at.k1")) & (F.hash("codes") == F.col("at.k2")))
        known = known.select(F.col("at.sid").alias("sid"), "codes").dropDuplicates(["sid"])
        known = written(known, f"{label}-codes")
        side = lambda x: known.select(F.col("sid").alias(x), F.col("codes").alias(f"{x}codes"))
        common = F.size(F.array_intersect("acodes", "bcodes"))
        alike = pairs.select(F.col("ata.sid").alias("a"), F.col("atb.sid").alias("b")).join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
        alike = alike.where(F.col("common") * 100 >= (F.size("acodes") + F.size("bcodes") - F.col("common")) * percent)
        return written(alike.select(F.col("b").alias("sid")).distinct(), f"{label}-losers")

    star = met.where("sid <> hub").select("sid", "hub").distinct().join(facts, "sid")
    star = named(star.select("hub", "n", "v0", "v1", "at"), "a", ["hub"]).join(named(facts.withColumnRenamed("sid", "hub"), "b", ["hub"]), "hub")
    gone = losers(star.where(_may_match(percent)), "star")

    # In keys of more than two sets, those that stand meet the earliest set, then the others before them (all have met the hub).
    members = met.where("size > 2 and sid <> hub").select("key", "sid", "p")
    out, _ = small_side(gone, broadcast_rows)
    asked, _ = small_side(written(members.join(out, "sid", "left_anti").select("key").distinct(), "asked"), broadcast_rows)
    before = F.when(F.col("p").between(1, MAX_PLACE - 1), _key_at(F.col("p") - 1)).alias("before")
    known = sets.select("sid", "n", "v0", "v1", "prefix", F.struct("first", "k1", "k2", "sid").alias("at"))
    members = members.join(asked, "key", "left_semi").join(known, "sid").join(out.withColumn("out", F.lit(True)), "sid", "left")
    members = written(members.select("key", "sid", "p", "n", "v0", "v1", "at", before, "out"), "members")
    forget(met)
    release(docs.sparkSession)
    right = named(members.drop("sid", "out"), "b", ["key"])
    standing = named(members.where("out is null").drop("out"), "a", ["key", "sid"])
    earliest = right.groupBy("key").agg(F.min(F.struct("atb", "nb", "v0b", "v1b")).alias("h")).select("key", "h.*")
    second = losers(standing.join(earliest, "key").where((F.col("atb") < F.col("ata")) & _may_match(percent)), "second")
    out, _ = small_side(second, broadcast_rows)
    new_run = ~F.coalesce(F.col("beforea") == F.col("beforeb"), F.lit(False))
    rest = standing.join(out, "sid", "left_anti").drop("sid").join(right, "key")
    rest = rest.where((F.col("atb") < F.col("ata")) & new_run & _may_match(percent) & _in_place(percent))
    gone = gone.unionByName(second).unionByName(losers(rest, "rest")).distinct().withColumn("gone", F.lit(True))

    judged = lines.join(sets.join(gone, "sid", "left").select("k1", "k2", "first", "gone"), ["k1", "k2"])
    first = F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("line_no") == F.col("first.l"))
    dropped = judged.where(F.col("gone").isNotNull() | ~first).select("doc_id", "text_key", "line_no").distinct()
    return written(dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line_no")).alias("dropped")), "dropped")


def dedup_lines(documents: DataFrame, shingle_words: int = 1, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """documents with removed lines taken out of `text`; all columns and rows stay, n_chars follows the text if there.

    A text that loses all its lines becomes empty; null stays null. Other cases as in decisions().
    """
    out, gone, kept = _applied(documents, decisions(documents, shingle_words, percent, broadcast_rows), broadcast_rows)
    changed = {"text": F.col(kept)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col(gone).isNotNull(), F.length(kept)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*documents.columns)


def _applied(documents: DataFrame, dropped: DataFrame, broadcast_rows: int) -> tuple[DataFrame, str, str]:
    """documents with two more columns, named in the result: numbers of removed lines (or null), and the text that stays."""
    d, t, gone, kept = (fresh(documents, c) for c in ("d", "t", "gone", "kept"))
    dropped, _ = small_side(dropped.withColumnsRenamed({"doc_id": d, "text_key": t, "dropped": gone}), broadcast_rows)
    same = documents["doc_id"].eqNullSafe(dropped[d]) & (_text_key(documents["text"]) == dropped[t])
    every = fresh(documents, "every")
    joined = documents.join(dropped, same, "left").select("*", _once(F.when(F.col(gone).isNotNull(), F.split("text", "\n"))).alias(every))
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col(every), i)), "\n")
    return joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)).drop(every), gone, kept


def report(documents: DataFrame, shingle_words: int = 1, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per input row: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null counts as empty)."""
    docs = documents.select("doc_id", "text")
    out, gone, kept = _applied(docs, decisions(docs, shingle_words, percent, broadcast_rows), broadcast_rows)
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )
