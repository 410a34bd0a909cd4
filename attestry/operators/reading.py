"""Reading documents into candidate values: labelled rows, machine-readable zones, sentences, and whose name it is.

Candidates: (set_id, field, value, source, rule_rank, seq); seq is a struct (file, tier, line, place) that orders them
as they are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.dates import lenient_date
from ..rules import LABELS
from .facts import RULES

# Fields whose values may wrap onto the next line.
JOINABLE = ("department", "education", "skills", "address", "degree", "language", "other")
# Words of organisations and of documents, which names don't hold.
ORGANISATION = (
    r"(?i)\b(universit|college|institute|polytechnic|academy|school|faculty|department|dept|engineering|technology|science|sciences|studies|"
    r"program|programme|ministry|office|registrar|bureau|agency|authority|company|ltd|inc|plc|corporation|foundation|centre|center|hospital|"
    r"clinic|bank|environment|built|federal|republic|democratic|immigration|nationality affairs)\b"
)
DOCUMENT = (
    r"(?i)\b(letter|certificate|statement|transcript|curriculum|vitae|resume|purpose|application|form|report|reference|sheet|subject|status|"
    r"concern|regards|sincerely|dear|passport|observation|page)\b"
)
NAME_SHAPE = r"^[A-ZÀ-Þ](?:[a-zà-ÿ'’.-]*|[A-ZÀ-Þ]*)(?:\s+[A-ZÀ-Þ](?:[a-zà-ÿ'’.-]*|[A-ZÀ-Þ]*)){1,3}$"
ZONE_LINE = r"^[A-Z0-9<]{20,}$"

# Longer alternatives first, so that the longest label at the start of a row is taken.
_HEADS = sorted((a for p, _ in LABELS for a in p.split("|") if "(" not in p), key=len, reverse=True)
_HEADS = [p for p, _ in LABELS if "(" in p] + _HEADS
ANY_LABEL = "(?:" + "|".join(_HEADS) + ")"


def label_field(head: Column) -> Column:
    """The field of a label that stands alone (marks after it don't count); null for anything else."""
    bare = F.trim(F.regexp_replace(head, r"[:\-–—\s]+$", ""))
    return F.coalesce(*[F.when(bare.rlike(f"(?i)^(?:{p})$"), F.lit(field)) for p, field in LABELS])


def title_case(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def without_zone(text: Column) -> Column:
    """The text without the lines of a machine-readable zone, whose digits look like phone numbers."""
    return F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: ~F.regexp_replace(x, r"\s+", "").rlike(ZONE_LINE)), "\n")


def _candidate(tier: int, rule: str, line: Column, place: Column) -> list[Column]:
    return [F.col("file_name").alias("source"), F.lit(RULES[rule]).alias("rule_rank"), F.struct(F.col("file_name").alias("file"), F.lit(tier).alias("tier"), line.cast("int").alias("line"), place.cast("int").alias("place")).alias("seq")]


def labelled_pairs(documents: DataFrame, this_year: int = 2026) -> DataFrame:
    """Candidates from "Label: value" rows of documents (set_id, file_name, text).

    A row starts with a label, followed by a mark, a gap of two spaces, or one space and a short value that doesn't
    continue a sentence; columns (gaps of two spaces, bars) that start with a label begin another pair. A label alone
    takes the next line. Values of JOINABLE fields take in a next line that is no row itself. Only files that hold a
    label at the start of a line or column are split into lines.
    """
    starts = rf"(?im)(?:^|[|]|\s\s)\s*{ANY_LABEL}(?:\s|[:|]|$)"
    lines = documents.where(F.coalesce("text", F.lit("")).rlike(starts)).select(
        "set_id", "file_name", F.posexplode(F.split(without_zone(F.col("text")), r"\r?\n")).alias("line", "raw")
    )
    row = F.trim(F.regexp_replace(F.regexp_replace("raw", r"[.…_]{3,}", "  "), r"\s*\|\s*", "  "))
    head = rf"(?is)^({ANY_LABEL})(\s*[:\-–—]+\s*|\s+|$)(.*)$"
    part = lambda x, i: F.regexp_extract(x, head, i)
    fact = lambda x: F.struct(label_field(part(x, 1)).alias("field"), F.trim(part(x, 3)).alias("value"), part(x, 2).rlike("[:\\-–—]").alias("marked"), x.alias("whole"))
    cells = F.transform(F.split(row, r"\s{2,}"), lambda x: fact(F.trim(x)))
    # Columns up to the next label belong to the pair before them: fold them into (field, value, separated).
    pair = "struct<field:string,value:string,sure:boolean>"
    folded = F.aggregate(
        "cells",
        F.array().cast(f"array<{pair}>"),
        lambda done, c: F.when(
            c["field"].isNotNull() & (c["value"].isNull() | (c["value"] == "") | c["marked"] | ((F.size(F.split(c["value"], " ")) <= 12) & ~c["value"].rlike("^[a-z]"))),
            F.concat(done, F.array(F.struct(c["field"].alias("field"), c["value"].alias("value"), c["marked"].alias("sure")))),
        )
        .when(F.size(done) == 0, F.array(F.struct(F.lit(None).cast("string").alias("field"), c["whole"].alias("value"), F.lit(False).alias("sure"))))
        .otherwise(
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["field"].alias("field"), F.trim(F.concat_ws(" ", F.element_at(done, -1)["value"], c["whole"])).alias("value"), F.lit(True).alias("sure"))),
            )
        ),
    )
    parsed = lines.withColumn("cells", cells).withColumn("pairs", folded).select("set_id", "file_name", "line", F.trim("raw").alias("raw"), "pairs")
    first = F.col("pairs")[0]
    parsed = parsed.withColumn("is_row", first["field"].isNotNull() & (first["value"] != "")).withColumn("is_label", first["field"].isNotNull() & (first["value"] == "") & (F.size("pairs") == 1))
    by_file = W.partitionBy("set_id", "file_name").orderBy("line")
    ahead = lambda c: F.lead(c).over(by_file)
    parsed = parsed.select("*", ahead("raw").alias("next"), (ahead("is_row") | ahead("is_label")).alias("next_row"))
    wraps = (F.col("next") != "") & (F.length("next") <= 120) & ~F.col("next_row") & ~F.col("next").rlike(r"^[A-Z\s]{4,}$")
    alone = F.col("is_label") & (F.col("next") != "") & ~F.col("next_row") & (F.length("next") <= 300)
    found = parsed.where(F.col("is_row") | alone)
    found = found.select("set_id", "file_name", "line", "next", "is_row", F.coalesce(wraps, F.lit(False)).alias("wraps"), F.size("pairs").alias("n"), F.posexplode("pairs").alias("place", "p"))
    value = F.when(~F.col("is_row"), F.col("next")).when(F.col("wraps") & (F.col("n") == 1) & F.col("p.field").isin(*JOINABLE), F.concat_ws(" ", "p.value", "next")).otherwise(F.col("p.value"))
    found = found.withColumn("value", value).where((F.col("value") != "") & (F.length("value") <= 300) & F.col("p.field").isNotNull())
    dated = F.when(F.col("p.field") == "dob", F.coalesce(lenient_date(F.col("value"), this_year), F.col("value"))).otherwise(F.col("value"))
    return found.select("set_id", F.col("p.field").alias("field"), dated.alias("value"), *_candidate(1, "labelled", F.col("line"), F.col("place")))


def typed(documents: DataFrame) -> DataFrame:
    """Distinct e-mail addresses, URLs and phone numbers (7 to 15 digits) of each file, in one pass."""
    whole = without_zone(F.coalesce("text", F.lit("")))
    tight = F.regexp_replace(whole, r"\s*([@.])\s*", "$1")
    each = lambda text, p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    some = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))
    urls = F.filter(each(tight, tx.URL), lambda u: ~F.contains(u, F.lit("@")))
    phones = F.transform(each(whole, tx.PHONE), lambda v: F.regexp_replace(F.trim(v), r"\s{2,}", " "))
    phones = F.filter(phones, lambda v: F.length(tx.digits_of(v)).between(7, 15))
    rows = documents.where(F.coalesce("text", F.lit("")).rlike("@|[0-9]|(?i)www\\.|(?i)http|\\.com/"))  # most files hold none
    rows = rows.select("set_id", "file_name", F.posexplode(F.concat(some("email", each(tight, tx.EMAIL)), some("url", urls), some("phone", phones))).alias("place", "x"))
    return rows.select("set_id", "x.field", "x.value", *_candidate(2, "typed", F.lit(0), F.col("place")))


def zone(documents: DataFrame) -> DataFrame:
    """Candidates from the two lines of a passport's machine-readable zone: name, passport, nationality, dob, gender."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    rows = documents.where(F.contains(F.coalesce("text", F.lit("")), F.lit("<<"))).select("set_id", "file_name", text.alias("t"))
    l1, l2 = r"P.?([A-Z]{3})([A-Z]+)<<([A-Z<]+?)<<<", r"([A-Z0-9<]{9})\d([A-Z]{3})(\d{6})\d([MFX<])(\d{6})"
    a, b = (lambda i: F.regexp_extract("t", l1, i)), (lambda i: F.regexp_extract("t", l2, i))
    born = F.concat(F.when(F.substring(b(3), 1, 2).cast("int") > 40, "19").otherwise("20"), F.regexp_replace(b(3), r"^(\d\d)(\d\d)(\d\d)$", "$1-$2-$3"))
    given, family = title_case(F.regexp_replace(a(3), "<", " ")), title_case(a(2))
    told = lambda field, value, ok: F.when(ok, F.struct(F.lit(field).alias("field"), value.alias("value")))
    found = F.array(
        told("name", F.concat_ws(" ", given, family), (given != "") & (family != "")),
        told("last_name", family, (given != "") & (family != "")),
        told("passport", F.regexp_replace(b(1), "<", ""), b(1) != ""),
        told("nationality", b(2), b(2) != ""),
        told("dob", born, b(3) != ""),
        told("gender", F.when(b(4) == "M", "Male").otherwise("Female"), (b(4) != "") & (b(4) != "<")),
    )
    rows = rows.select("set_id", "file_name", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("place", "x"))
    return rows.select("set_id", "x.field", "x.value", *_candidate(3, "typed", F.lit(0), F.col("place")))


def contextual(documents: DataFrame) -> DataFrame:
    """Candidates from sentences: who is certified, ID numbers, year standing, universities."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.where(text.rlike(r"(?i)certify\s+that|\bID\s*No|\byear\b|University|Institute of Technology")).select("set_id", "file_name", without_zone(text).alias("t"))
    certified = r"(?iu)certify\s+that\s+([A-ZÀ-Þ][\p{L}'’.-]*(?:\s+[A-ZÀ-Þ][\p{L}'’.-]*){1,3}?)\s*(?:,|\bis\b|\bhas\b|$)\s*(?:ID\s*No\.?\s*[:.]?\s*([A-Z0-9/\-]+))?"
    number, year = r"(?i)\bID\s*No\.?\s*[:.]?\s*([A-Z0-9][A-Z0-9/\-]{3,})", r"(?i)\b((?:\d(?:st|nd|rd|th)|first|second|third|fourth|fifth)\s+year)\b"
    school = r"\b([A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*){0,4}\s+(?:University|Institute of Technology))\b"
    told = lambda field, value, ok=None: F.when((value != "") & (ok if ok is not None else F.lit(True)), F.struct(F.lit(field).alias("field"), F.trim(value).alias("value")))
    who = F.regexp_extract("t", certified, 1)
    found = F.array(
        told("name", who, who.rlike(NAME_SHAPE)), told("id", F.regexp_extract("t", number, 1)),
        told("year_standing", title_case(F.regexp_extract("t", year, 1))), told("education", F.regexp_extract("t", school, 1)),
    )
    rows = rows.select("set_id", "file_name", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("place", "x"))
    return rows.select("set_id", "x.field", "x.value", *_candidate(4, "contextual", F.lit(0), F.col("place")))


def positional(documents: DataFrame) -> DataFrame:
    """Every name-shaped line of the first eight with text, as a candidate for the name."""
    lines = F.filter(F.transform(F.split(without_zone(F.coalesce("text", F.lit(""))), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = documents.select("set_id", "file_name", F.posexplode(F.slice(lines, 1, 8)).alias("line", "value"))
    shaped = (F.length("value") <= 60) & ~F.col("value").rlike(r"[@\d]") & F.col("value").rlike(NAME_SHAPE)
    return rows.where(shaped).select("set_id", F.lit("name").alias("field"), "value", *_candidate(5, "positional", F.col("line"), F.lit(0)))


def all_candidates(documents: DataFrame, this_year: int = 2026) -> DataFrame:
    """All candidates in the order of reading: labelled, typed, zone, sentences, header lines."""
    parts = [labelled_pairs(documents, this_year), typed(documents), zone(documents), contextual(documents), positional(documents)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name_tokens(value: Column) -> Column:
    """Words of three letters and more, lower case, without marks of accents."""
    plain = F.regexp_replace(F.translate(F.lower(value), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), r"[^a-z\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 2)


def best_names(candidates: DataFrame) -> DataFrame:
    """(set_id, value, source, corroboration, score, confidence): the best name of each set by what speaks for it.

    The rule (50, 45, 25, 5), agreement with the machine-readable zone (two tokens +60, one +25) and with e-mail handles and
    profile URLs (+50, +20), 12 for each further file up to three, less 70 for words of organisations and 40 for
    those of documents. Signals are gathered by set before they meet the candidates: a set with many files is no group.
    """
    names = candidates.where((F.col("field") == "name") & (F.trim("value") != ""))
    grouped = names.groupBy("set_id", F.lower(F.trim("value")).alias("key")).agg(
        F.countDistinct("source").alias("files"), F.min(F.struct((-F.col("rule_rank")).alias("r"), "seq", "value", "source")).alias("best")
    )
    zoned = names.where(F.col("seq.tier") == 3).groupBy("set_id").agg(F.min(F.struct("seq", "value"))["value"].alias("zone"))
    handle = F.when(F.col("field") == "email", F.substring_index("value", "@", 1)).otherwise(F.col("value"))
    handles = candidates.where(F.col("field").isin("email", "url")).select("set_id", F.regexp_replace(F.lower(handle), "[^a-z]", "").alias("handle")).distinct()
    # A token meets handles one by one: (set, token) pairs that any handle holds.
    tokens = grouped.select("set_id", "key", F.explode(F.array_distinct(name_tokens(F.col("best.value")))).alias("token"))
    held = tokens.select("set_id", "token").distinct().join(handles, "set_id").where(F.contains("handle", "token")).select("set_id", "token").distinct().withColumn("held", F.lit(1))
    hits = tokens.join(held, ["set_id", "token"], "left").groupBy("set_id", "key").agg(F.count("held").alias("hits"))
    joined = grouped.join(zoned, "set_id", "left").join(hits, ["set_id", "key"], "left")
    overlap = F.size(F.array_intersect(name_tokens(F.col("best.value")), name_tokens(F.col("zone"))))
    rank = -F.col("best.r")
    points = lambda n, two, one: F.when(n >= 2, two).when(n == 1, one).otherwise(0)
    score = (
        F.when(rank == 4, 50).when(rank == 3, 45).when(rank == 2, 25).otherwise(5)
        + F.when(F.col("zone").isNotNull(), points(overlap, 60, 25)).otherwise(0)
        + points(F.coalesce("hits", F.lit(0)), 50, 20)
        + F.least(F.col("files") - 1, F.lit(3)) * 12
        - F.when(F.col("best.value").rlike(ORGANISATION), 70).otherwise(0)
        - F.when(F.col("best.value").rlike(DOCUMENT), 40).otherwise(0)
    )
    score = F.when(F.size(name_tokens(F.col("best.value"))) == 0, -100).otherwise(score).cast("long")
    best = joined.select("set_id", score.alias("score"), F.trim("best.value").alias("value"), F.col("best.seq").alias("seq"), F.col("best.source").alias("source"), F.col("files").alias("corroboration"))
    best = best.groupBy("set_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "seq", "value", "source", "corroboration")).alias("b"))
    out = best.select("set_id", "b.value", "b.source", "b.corroboration", (-F.col("b.s")).alias("score"))
    return out.withColumn("confidence", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def name_score(candidates: DataFrame) -> DataFrame:
    """(set_id, value, score, confidence) of best_names."""
    return best_names(candidates).select("set_id", "value", "score", "confidence")
