"""Every question to one tier, with what the tiers before refused and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching
from ..operators.questions import declaration_kind
from ..work import sorted_side

GRIDS = ("multiple_choice_grid", "checkbox_grid")
FILES = ("file", "file_upload")


def resolve_questions(questions: DataFrame, facts: DataFrame, dossier: DataFrame, defaults: DataFrame, answers: DataFrame, evidence: DataFrame, uploads: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(form_id, q_idx, tier, state, answer, source, refused): one row for each question, from the first tier that settles it.

    questions: (form_id, q_idx, set_id, key, label, kind, manual_only, is_choice, options). In order:

    * manual, grid: no answer is sought.
    * file: the matched document of `uploads` (form_id, q_idx, file_name, confidence), see document_match.
    * facts (set_id, field, value, source, confidence, seq, rule_rank) by profile_match. The dossier (set_id, key, value, source, confidence)
      may agree or hold a longer spelling, which wins; a labelled fact beats one that isn't sure; else the two are in conflict. A choice that no option
      stands for needs input and goes no further.
    * declaration: the person's default (declaration, value) as a draft, without one it needs input.
    * supplied: answers (form_id, q_idx, status, value, confidence) as their evidence (form_id, q_idx, source, value, seq) lets them stand, see
      evidence_gate and acronym_links for `links` (answer_id a struct of form_id and q_idx).
    * retry: none of them, and no answer was supplied.

    refused has `tier: reason` of the tiers that were asked before, in order. Each tier is joined on equality; no row of one meets all of another.
    """
    at = F.struct("form_id", "q_idx")
    q = questions.withColumn("q_id", at).withColumn("plain", ~F.col("manual_only") & ~F.col("kind").isin(*GRIDS, *FILES))
    told = matching.profile_match(q.where("plain").select("q_id", "set_id", "key", "is_choice", "options"), facts)
    told = told.select("q_id", F.col("key").alias("asked"), F.col("value").alias("fact"), F.col("source").alias("fact_source"), "outcome")
    rank = facts.groupBy("set_id", F.col("field").alias("asked"), F.col("source").alias("fact_source")).agg(F.max("rule_rank").alias("rule_rank"))
    others = dossier.select("set_id", F.col("key").alias("asked"), F.col("value").alias("other"), F.col("source").alias("other_source"), F.col("confidence").alias("sure"))
    gated = matching.evidence_gate(evidence.select(at.alias("answer_id"), "source", "value", "seq"), answers.select(at.alias("answer_id"), "status", "value", "confidence"), links)
    gated = gated.select(F.col("answer_id").alias("q_id"), "status", F.col("value").alias("given"))
    cited = matching.cited_files(evidence.select(at.alias("answer_id"), "source")).select(F.col("answer_id").alias("q_id"), F.col("files").alias("cited"))
    kept = defaults.select("declaration", F.col("value").alias("default"))
    found = uploads.select(at.alias("q_id"), "file_name", F.col("confidence").alias("fit"))

    rows = q.withColumn("declaration", F.when(F.col("plain"), declaration_kind(F.col("label"))))
    for side in (told, gated, cited, found):
        rows = rows.join(sorted_side(side), "q_id", "left")
    rows = rows.join(sorted_side(rank), ["set_id", "asked", "fact_source"], "left").join(sorted_side(others), ["set_id", "asked"], "left").join(kept, "declaration", "left")

    a, b = tx.reduced(F.col("fact")), tx.reduced(F.col("other"))
    alike = F.col("other").isNull() | (a == b)
    within = F.contains(a, b) | F.contains(b, a)
    longer = within & (F.length("other") > F.length("fact"))
    wins = (F.coalesce("rule_rank", F.lit(0)) >= 4) & (F.col("sure") != "high")
    clash = ~(alike | within | wins)
    fact_answer = F.when(~alike & longer & ~F.col("is_choice"), F.col("other")).when(~clash, F.col("fact"))
    fact_source = F.when(~alike & longer & ~F.col("is_choice"), F.col("other_source")).otherwise(F.col("fact_source"))
    stuck = F.col("is_choice") & F.col("outcome").isin("no option", "no part")

    tier = (
        F.when(F.col("manual_only"), "manual").when(F.col("kind").isin(*GRIDS), "grid").when(F.col("kind").isin(*FILES), "file")
        .when((F.col("outcome") == "matched") | stuck, "facts").when(F.col("declaration").isNotNull() & (F.col("declaration") != "none"), "declaration").when(F.col("status").isNotNull(), "supplied").otherwise("retry")
    )
    rows = rows.withColumn("tier", tier)
    t = F.col("tier")
    state = (
        F.when(t == "manual", "manual only").when(t == "grid", "needs input").when(t == "file", F.when(F.col("file_name").isNull(), "needs input").otherwise("file matched"))
        .when(t == "facts", F.when(stuck, "needs input").when(clash, "conflict").otherwise("from documents")).when(t == "declaration", F.when(F.col("default").isNull(), "needs input").otherwise("draft"))
        .when(t == "supplied", F.when(F.col("status") == "conflicting_sources", "conflict").when(F.col("status") == "needs_user_input", "needs input").otherwise("from documents")).otherwise("error")
    )
    rows = rows.withColumn("state", state)
    answered = F.col("state").isin("from documents", "draft", "file matched")
    answer = F.when(t == "file", F.col("file_name")).when(t == "facts", fact_answer).when(t == "declaration", F.col("default")).when(t == "supplied", F.col("given"))
    source = F.when(t == "facts", fact_source).when(t == "supplied", F.col("cited"))
    asked_facts = F.col("plain") & (t != "facts")
    no_fact = F.when(asked_facts, F.concat(F.lit("facts: "), F.coalesce("outcome", F.lit("no key"))))
    no_declaration = F.when(t.isin("supplied", "retry"), F.lit("declaration: none"))
    no_answer = F.when(t == "retry", F.lit("supplied: no answer"))
    refused = F.filter(F.array(no_fact, no_declaration, no_answer), lambda x: x.isNotNull())
    return rows.select("form_id", "q_idx", "tier", "state", F.when(answered, answer).alias("answer"), F.when(answered, source).alias("source"), refused.alias("refused"))
