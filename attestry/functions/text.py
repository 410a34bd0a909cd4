"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code point ranges of scripts with the language each stands for, in tie order.
SCRIPTS = [
    ("am", r"[\x{1200}-\x{137f}]"),
    ("ar", r"[\x{600}-\x{6ff}]"),
    ("he", r"[\x{590}-\x{5ff}]"),
    ("hi", r"[\x{900}-\x{97f}]"),
    ("ru", r"[\x{400}-\x{4ff}]"),
    ("zh", r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"),
    ("el", r"[\x{370}-\x{3ff}]"),
    ("und", r"[A-Za-z\x{c0}-\x{24f}]"),
]
RIGHT_TO_LEFT = ("ar", "he")

#: Letters, digits and marks that a clean read may hold; everything else is odd.
ODD = r"[^\p{L}\p{N}\s.,:/@+()'’-]"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"(?i)\b(?:https?://|www\.|linkedin\.com/in/|github\.com/)[^\s)<>\"']+"
PHONE = r"\+?\d[\d\s().-]{6,}\d"


def letters_of(text: Column, pattern: str) -> Column:
    """How many characters match; replacing the rest at once is cheaper than one match for each."""
    return F.length(F.regexp_replace(text, "[^" + pattern[1:-1] + "]+", "")).cast("long")


def letters_by_script(df: DataFrame, text: str) -> DataFrame:
    """df with a column of counts for each of SCRIPTS instead of `text`; null counts as empty.

    ASCII is searched once, for its letters; the scripts only in what is left without it, which of most texts is little.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rest = F.when(F.octet_length(plain) == F.length(plain), F.lit("")).otherwise(F.regexp_replace(plain, r"[\x00-\x7f]+", ""))
    ascii_letters = F.length(plain).cast("long") - F.length(F.regexp_replace(plain, "[A-Za-z]+", "")).cast("long")
    parts = df.select(*[c for c in df.columns if c != text], ascii_letters.alias("_ascii"), rest.alias("_rest"))
    counts = [letters_of(F.col("_rest"), p) + (F.col("_ascii") if "A-Za-z" in p else F.lit(0)) for _, p in SCRIPTS]
    return parts.select(*[c for c in df.columns if c != text], *[n.alias(code) for n, (code, _) in zip(counts, SCRIPTS, strict=True)])


def odd_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[" + ODD[2:-1] + "]+", "")).cast("long")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def reduced(value: Column) -> Column:
    """Lower case without anything but letters, digits, @ and +: what values are compared by."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9@+]", "")


def plain_words(value: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def cleaned(label: Column) -> Column:
    """Trimmed lower-case label without trailing marks."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), r"[*?!.,:;]+$", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of trimmed lower-case labels without trailing marks; 0 if either is blank."""
    x, y = cleaned(a), cleaned(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longer)
