"""Audits of answers and drafts, and jobs on their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Phrases that show a draft talks about itself, and the shape of a file name.
LEAKED = (
    r"(?i)\b(as an ai|as a language model|i cannot|i can't|i'm unable to|i am unable to|i don't have access|"
    r"i do not have access|please provide|write something|based on the uploaded|as a placeholder)\b"
)
FILE_NAME = r"\.[A-Za-z0-9]{2,5}$"


def leak_guard(drafts: DataFrame) -> DataFrame:
    """Drafts (conv_id, role, text) by role: all, and those that must be blanked."""
    leaked = F.coalesce(F.col("text"), F.lit("")).rlike(LEAKED)
    return drafts.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.when(leaked, 1).otherwise(0)).alias("leaked"))


def answer_state(manual_only: Column, conflict: Column, value: Column, source: Column, user_provided: Column, composed: Column, backed: Column) -> Column:
    """One state for an answer, the first that holds."""
    return (
        F.when(manual_only, "manual only")
        .when(conflict, "conflict")
        .when(F.trim(F.coalesce(value, F.lit(""))) == "", "needs input")
        .when(source.rlike(FILE_NAME), "from documents")
        .when(source == "profile", "from profile")
        .when(user_provided, "user provided")
        .when(composed & backed, "composed")
        .otherwise("needs input")
    )


def provenance_audit(answers: DataFrame) -> DataFrame:
    """Answers (form_id, q_idx, state, source) stored as from documents whose source is no file name, per form:
    (form_id, n, violations)."""
    bad = (F.col("state") == "from documents") & ~F.coalesce(F.col("source"), F.lit("")).rlike(FILE_NAME)
    return answers.groupBy("form_id").agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("violations"))


def state_distribution(answers: DataFrame) -> DataFrame:
    """Answers by form and state with totals by form and over all: (form_id, state, n, level)."""
    return answers.rollup("form_id", "state").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).withColumn("level", F.col("level").cast("long"))


def section_fingerprint(items: DataFrame) -> DataFrame:
    """(conv_id, n, fingerprint) of ordered texts; items: (conv_id, turn, text). Texts are hashed before they are gathered."""
    hashed = items.select("conv_id", F.struct("turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), "|")
    return hashed.groupBy("conv_id").agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("fingerprint"))


def section_changes(items: DataFrame) -> DataFrame:
    """Turns whose role differs from the one before: (conv_id, turn, role, changed)."""
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return items.select("conv_id", "turn", "role", F.coalesce(F.col("role") != before, F.lit(True)).alias("changed"))


def report_gate(answers: DataFrame) -> DataFrame:
    """Per form: drafts, conflicts, needs-input answers, and whether none is left."""
    of = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    sums = answers.groupBy("form_id").agg(of("draft").alias("drafts"), of("conflict").alias("conflicts"), of("needs input").alias("needs_input"))
    return sums.withColumn("verified", (F.col("drafts") + F.col("conflicts") + F.col("needs_input")) == 0)
