"""Dates and times of day as columns, each text taken apart once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
WORDED = r"^(\d{1,2})?\s*([A-Za-z]{3,})\.?,?\s*(\d{1,2})?,?\s*(\d{4})$"
NUMERIC = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def month_number(word: Column) -> Column:
    """1 to 12 for the name of a month or the first three letters or more of one; null else."""
    low = F.lower(word)
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.left(low, F.lit(3))).cast("int")
    return F.when((at > 0) & (F.length(low) >= 3) & F.startswith(F.get(F.array(*map(F.lit, MONTHS)), at - 1), low), at)


def real_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if there is such a day, else null."""
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), "yyyy-MM-dd")


def known_date(raw: Column, order: Column) -> Column:
    """(date, reason): the one day that a text can mean as YYYY-MM-DD, or why it is refused.

    Year first is as it stands; a month in words says which is which; of two numbers before a year one over 12 is the day, and
    else `order` (DMY or MDY) has to say. Refused: blank (null too), impossible, ambiguous, unknown format.
    """
    outcome = lambda year, month, day: F.struct(year.alias("y"), month.alias("m"), day.alias("d"), F.lit(None).cast("string").alias("why"))
    no = F.lit(None).cast("int")
    refused = lambda why: F.struct(no.alias("y"), no.alias("m"), no.alias("d"), F.lit(why).alias("why"))

    def numeric(n: Column) -> Column:
        a, b, y = (F.get(n, i) for i in range(3))
        return (
            F.when(a > 99, outcome(a, b, y)).when((a > 12) & (b > 12), refused("impossible")).when(a > 12, outcome(y, b, a)).when(b > 12, outcome(y, a, b))
            .when(order == "DMY", outcome(y, b, a)).when(order == "MDY", outcome(y, a, b)).otherwise(refused("ambiguous"))
        )

    def worded(w: Column) -> Column:
        day = F.coalesce(F.get(w, 0).try_cast("int"), F.get(w, 2).try_cast("int"))
        return let(month_number(F.get(w, 1)), lambda m: F.when(m.isNull(), refused("unknown format")).otherwise(outcome(F.get(w, 3).cast("int"), m, day)))

    def read(v: Column) -> Column:
        # a year is written with four digits: `0004` and 4 are told apart by length
        year_first = F.length(F.substring_index(F.translate(v, "/.", "--"), "-", 1)) == 4
        n = F.transform(F.split(v, r"[-/.]"), lambda x: x.cast("int"))
        w = F.split(F.regexp_replace(v, WORDED, "$1|$2|$3|$4"), r"\|")
        return (
            F.when(v == "", refused("blank"))
            .when(v.rlike(NUMERIC), let(n, lambda x: F.when(year_first, outcome(F.get(x, 0), F.get(x, 1), F.get(x, 2))).otherwise(numeric(x))))
            .when(v.rlike(WORDED), let(w, worded)).otherwise(refused("unknown format"))
        )

    def settle(r: Column) -> Column:
        day = real_date(r["y"], r["m"], F.coalesce(r["d"], F.lit(0)))
        return let(F.when(r["why"].isNull(), day), lambda d: F.struct(d.alias("date"), F.when(d.isNull(), F.coalesce(r["why"], F.lit("impossible"))).alias("reason")))

    return let(let(F.trim(F.coalesce(raw, F.lit(""))), read), settle)


def date_order(hint: Column) -> Column:
    """DMY, MDY or YMD as a placeholder such as DD/MM/YYYY states it; `unknown` rather than a default."""
    letters = F.regexp_replace(F.lower(F.coalesce(hint, F.lit(""))), "[^dmy]", "")
    return F.when(F.startswith(letters, F.lit("ddmm")), "DMY").when(F.startswith(letters, F.lit("mmdd")), "MDY").when(F.startswith(letters, F.lit("yy")), "YMD").otherwise("unknown")


def time_of_day(raw: Column) -> Column:
    """HH:MM by 24 hours of the first h:mm in a text, with am or pm after it or not; null without one or for no time of day."""

    def read(v: Column) -> Column:
        hours, minutes, half = F.get(v, 0).cast("int"), F.get(v, 1), F.get(v, 2)
        hour = F.when((half == "pm") & (hours < 12), hours + 12).when((half == "am") & (hours == 12), 0).otherwise(hours)
        return F.when((hour <= 23) & (minutes.cast("int") <= 59), F.format_string("%02d:%s", hour, minutes))

    clock = r"(?is)^.*?(\d{1,2}):(\d{2})\s*(am|pm)?.*$"
    return F.when(raw.rlike(clock), let(F.split(F.lower(F.regexp_replace(raw, clock, "$1|$2|$3")), r"\|"), read))


def lenient_date(raw: Column, this_year: int) -> Column:
    """A printed date as ISO, read day first, two-digit years after `this_year` as 19xx; null for other text.

    Only for comparing spellings of one date; a date column is read by known_date, which refuses to guess.
    """
    shapes = [
        (r"\b(\d{4})-(\d{2})-(\d{2})\b", "$1|$2|$3", False), (r"\b(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4}|\d{2})\b", "$3|$2|$1", True),
        (r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}|\d{2})\b", "$3|$1|$2", True), (r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b", "$3|$2|$1", False),
    ]

    def joined(named: bool, w: Column) -> Column:
        y, m, d = (F.get(w, i) for i in range(3))
        at = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.lower(F.left(m, F.lit(3))))
        month = F.when(at > 0, at.cast("string")) if named else m
        year = F.when(F.length(y) == 4, y).when(y.cast("int") > this_year % 100, F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
        return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))

    def one(pattern: str, into: str, named: bool) -> Column:
        parts = F.split(F.regexp_replace(raw, f"(?s)^.*?{pattern}.*$", into), r"\|")
        return F.when(raw.rlike(pattern), let(parts, lambda w: joined(named, w)))

    return F.coalesce(*[one(*s) for s in shapes])
