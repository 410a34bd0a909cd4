"""From candidate values to facts. Candidates: (set_id, field, value, source, rule_rank, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.dates import known_date, time_of_day

#: Rank of how a candidate was read, and fields that keep all their values.
RULES = {"labelled": 4, "typed": 3, "contextual": 2, "positional": 1}
MULTI_VALUED = ("email", "url", "phone", "skills", "language")


def corroborate(candidates: DataFrame) -> DataFrame:
    """One row for each (set_id, field, lower(trim(value))): sources that agree, and the value as the best rule,
    seen first, spells it. Blank values say nothing."""
    key = F.lower(F.trim("value"))
    grouped = candidates.where(F.trim("value") != "").groupBy("set_id", "field", key.alias("key")).agg(
        F.countDistinct("source").alias("corroboration"), F.min(F.struct((-F.col("rule_rank")).alias("r"), "seq", "value", "source")).alias("best")
    )
    return grouped.select("set_id", "field", "key", "corroboration", F.trim("best.value").alias("value"), F.col("best.source").alias("source"), (-F.col("best.r")).alias("rule_rank"), F.col("best.seq").alias("seq"))


def confidence(rule_rank: Column, corroboration: Column) -> Column:
    """high: labelled or typed; a sentence is medium, a place low, and each one better if several files agree."""
    several = corroboration > 1
    return F.when((rule_rank >= 3) | ((rule_rank == 2) & several), "high").when((rule_rank == 2) | several, "medium").otherwise("low")


def reconcile_facts(candidates: DataFrame) -> DataFrame:
    """Facts: multi-valued fields keep every value, others the best by rule, corroboration and first place."""
    agreed = corroborate(candidates)
    best = W.partitionBy("set_id", "field").orderBy(F.desc("rule_rank"), F.desc("corroboration"), "seq")
    multi = F.col("field").isin(*MULTI_VALUED)
    kept = agreed.withColumn("rank", F.row_number().over(best)).where(multi | (F.col("rank") == 1))
    return kept.select("set_id", "field", "value", "source", "corroboration", confidence(F.col("rule_rank"), F.col("corroboration")).alias("confidence"))


def manual_override(derived: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual facts win their (set_id, field); derived ones fill the other fields."""
    return manual.unionByName(derived.join(manual.select("set_id", "field").distinct(), ["set_id", "field"], "left_anti"))


# Words that make a value an organisation or a heading, not a person, place or gender.
NO_PERSON = (
    r"(?i)\b(universit|college|institute|polytechnic|academy|school|faculty|department|dept|ministry|office|registrar|company|ltd|inc|plc|"
    r"corporation|foundation|hospital|bank|letter|certificate|statement|transcript|curriculum|vitae|resume|application|form)\b"
)


def plausible(field: Column, value: Column) -> Column:
    """Whether a value has the shape that its field asks for; other fields pass. The shapes are fixed values."""
    v = F.trim(value)
    digits = F.length(tx.digits_of(v))
    words = F.size(F.split(v, r"\s+"))
    named = ~v.rlike("[0-9]") & ~v.rlike(NO_PERSON)
    return (
        F.when(F.length(v) == 0, False)
        .when(field.isin("name", "first_name", "middle_name", "last_name"), named & (F.length(v) <= 60) & (words <= 5))
        .when(field == "email", v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"))
        .when(field == "phone", digits.between(7, 15))
        .when(field == "dial_code", v.rlike(r"^\+[0-9]{1,4}$"))
        .when(field == "dob_year", v.rlike(r"^(19|20)[0-9]{2}$"))
        .when(field == "dob_month", v.rlike(r"^(0?[1-9]|1[0-2])$"))
        .when(field == "dob_day", v.rlike(r"^(0?[1-9]|[12][0-9]|3[01])$"))
        .when(field == "dob", v.rlike("[0-9]") & (F.length(v) <= 40))
        .when(field == "url", v.rlike(r"\.") & ~v.rlike(r"\s"))
        .when(field == "postal_code", v.rlike(r"^[A-Za-z0-9][A-Za-z0-9 -]{1,11}$"))
        .when(field == "id", v.rlike("[0-9]") & (F.length(v) <= 40) & (words <= 4))
        .when(field.isin("country", "nationality", "city", "state", "gender"), named & (F.length(v) <= 56))
        .when(field == "years_experience", v.rlike("[0-9]") & (F.length(v) <= 24))
        .when(field.isin("education", "employer", "job_title", "language", "address"), F.length(v) <= 200)
        .otherwise(True)
    )


def plausibility_gate(candidates: DataFrame) -> DataFrame:
    """Accepted and rejected candidates for each field."""
    ok = plausible(F.col("field"), F.col("value"))
    return candidates.groupBy("field").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("accepted"), F.sum(F.when(ok, 0).otherwise(1)).alias("rejected"))


def dossier_reconcile(facts: DataFrame, dossier: DataFrame) -> DataFrame:
    """Facts (key, value, rule_rank) against the dossier (key, value, confidence), compared without marks:
    agree, contained (the longer stays), fact wins (labelled against less than high), or conflict."""
    d = dossier.select("key", F.col("value").alias("other"), F.col("confidence").alias("other_confidence"))
    a, b = tx.reduced(F.col("value")), tx.reduced(F.col("other"))
    verdict = (
        F.when(F.col("other").isNull(), "only fact")
        .when(a == b, "agree")
        .when(F.contains(a, b) | F.contains(b, a), "contained")
        .when((F.col("rule_rank") >= 4) & (F.col("other_confidence") != "high"), "fact wins")
        .otherwise("conflict")
    )
    longer = F.when(F.length("other") > F.length("value"), F.col("other")).otherwise(F.col("value"))
    joined = facts.join(d, "key", "left").withColumn("verdict", verdict)
    return joined.select("key", "verdict", F.when(F.col("verdict") == "contained", longer).when(F.col("verdict") != "conflict", F.col("value")).alias("resolved"))


def date_audit(dates: DataFrame) -> DataFrame:
    """(set_id, raw, order_hint) -> raw, normalised date or the reason why it is refused; see dates.known_date."""
    read = dates.select("set_id", "raw", known_date(F.col("raw"), F.col("order_hint")).alias("r"))
    return read.select("set_id", "raw", "r.date", "r.reason")


def time_audit(times: DataFrame) -> DataFrame:
    """(set_id, raw) -> raw and the time of day as HH:MM, null where it is none; see dates.time_of_day."""
    return times.select("set_id", "raw", time_of_day(F.col("raw")).alias("time"))


def date_counts(dates: DataFrame) -> DataFrame:
    """Accepted and refused dates of each set by reason."""
    return date_audit(dates).groupBy("set_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
