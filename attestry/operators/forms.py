"""Jobs over form fields (as sources.html.page_fields returns them) and over trees of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..work import sorted_side

# Names of fields that hold payment cards.
PAYMENT = r"(?i)card[\s_-]?number|cc[\s_-]?num|cvv|cvc|security[\s_-]?code|expir"


def substantial_forms(fields: DataFrame) -> DataFrame:
    """fields of forms with two fields or more, on pages that have such a form; all fields of other pages."""
    form, page = W.partitionBy("page_id", "form"), W.partitionBy("page_id")
    large = F.col("form").isNotNull() & (F.count("*").over(form) >= 2)
    seen = fields.repartition("page_id").withColumn("_large", large)
    seen = seen.withColumn("_has", F.max(F.col("_large").cast("int")).over(page))
    return seen.where((F.col("_has") == 0) | F.col("_large")).select(*fields.columns)


def manual_only_flags(fields: DataFrame) -> DataFrame:
    """fields with `manual_reason` of those that only the person may fill: passwords, payment cards, and all fields of a form
    with a password and at most four fields; null for others."""
    form = W.partitionBy("page_id", "form")
    login = F.col("form").isNotNull() & (F.max((F.col("type") == "password").cast("int")).over(form) == 1) & (F.count("*").over(form) <= 4)
    words = F.concat_ws(" ", "autocomplete", "name", "label")
    card = F.coalesce(F.startswith("autocomplete", F.lit("cc-")), F.lit(False)) | words.rlike(PAYMENT)
    reason = F.when(F.col("type") == "password", "password field").when(card, "payment card field").when(F.col("_login"), "part of a login form")
    seen = fields.repartition("page_id").withColumn("_login", login)
    return seen.select(*fields.columns, reason.alias("manual_reason"))


def option_groups(fields: DataFrame) -> DataFrame:
    """Questions (page_id, seq, label, type, options, rows, required, manual_reason) of fields with manual_reason.

    Radio buttons and checkboxes of one name, in one form or outside of all, are one question with their labels as options,
    required if any is, manual for the first reason; its label is the legend, or the name. Radio buttons whose labels are all
    numbers are a linear_scale. Others are questions of their own, grids too; those without a label go. A nameless button is a group by
    itself.
    """
    grouped = F.col("type").isin("radio", "checkbox")
    key = F.when(grouped & F.col("name").isNotNull() & (F.col("name") != ""), F.concat_ws(":", "type", F.when(F.col("form").isNotNull(), "in-form").otherwise("no-form"), "name")).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    rows = fields.select("page_id", key.alias("key"), "seq", "label", "type", "options", "rows", "required", "manual_reason", "legend", "name", grouped.alias("grouped"))
    item = F.struct("seq", "label")
    reason = F.min(F.when(F.col("manual_reason").isNotNull(), F.struct("seq", "manual_reason")))["manual_reason"]
    first = F.min(F.struct("seq", "label", "type", "legend", "name", "options", "rows", "grouped"))
    out = rows.groupBy("page_id", "key").agg(
        first.alias("f"), F.max(F.col("required").cast("int")).alias("r"), reason.alias("manual_reason"), F.count("*").alias("n"), F.collect_list(F.when(F.col("grouped"), item)).alias("members")
    )
    labels = F.filter(F.transform(F.sort_array("members"), lambda x: x["label"]), lambda x: x != "")
    asked = F.when(F.col("f.grouped") & ((F.col("n") > 1) | (F.col("f.type") == "radio")), F.coalesce("f.legend", F.regexp_replace("f.name", "[_-]+", " "), "f.label")).otherwise(F.col("f.label"))
    kind = (
        F.when(F.col("f.type").isin("multiple_choice_grid", "checkbox_grid"), F.col("f.type"))
        .when((F.col("f.type") == "radio") & (F.size(labels) > 0) & F.forall(labels, lambda x: x.rlike("^[0-9]+$")), "linear_scale").when(F.col("f.type") == "radio", "multiple_choice").when(F.col("f.type") == "checkbox", "checkboxes").when(F.col("f.type") == "select", "dropdown")
        .when(F.col("f.type") == "paragraph", "paragraph").when(F.col("f.type").isin("date", "time"), F.col("f.type")).when(F.col("f.type") == "file", "file_upload").otherwise("short_answer")
    )
    options = F.when(F.col("f.grouped"), labels).otherwise(F.col("f.options"))
    out = out.select("page_id", F.col("f.seq").alias("seq"), F.trim(asked).alias("label"), kind.alias("type"), options.alias("options"), F.col("f.rows").alias("rows"), (F.col("r") == 1).alias("required"), "manual_reason")
    return out.where(F.col("label") != "")


def field_coverage(questions: DataFrame) -> DataFrame:
    """(page_id, type, n, manual_only, without_options, level): questions of each page by type, of each page, of all."""
    choice = F.col("type").isin("multiple_choice", "checkboxes", "dropdown", "linear_scale", "multiple_choice_grid", "checkbox_grid")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return questions.rollup("page_id", "type").agg(
        F.count("*").alias("n"), one(F.col("manual_reason").isNotNull()).alias("manual_only"), one(choice & (F.size("options") == 0)).alias("without_options"), F.grouping_id().cast("long").alias("level")
    )


# Frames


def url_tiers(url: Column) -> list[Column]:
    """The URL by falling strictness: whole, without fragment, origin and path, origin. Null where it has no such part."""
    some = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return [F.nullif(url, F.lit("")), F.nullif(F.substring_index(url, "#", 1), F.lit("")), some(r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*[^?#]*)"), some(r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)")]


def slot_placement(frames: DataFrame, slots: DataFrame) -> DataFrame:
    """(page_id, frame_id, method, slot_idx, ord): where child frames stand among their parent's slots.

    frames: (page_id, frame_id, parent_frame_id, url, self_slot, scanned); slots: (page_id, frame_id of the parent, slot_idx, src,
    ord). root; frame-element (the child knows its slot); src-match by the first tier of the URL with any hit, if that is one;
    else unresolved: `ambiguous`, `no match`, or `parent silent`. Ambiguity is never guessed away.
    """
    scanned = frames.where("scanned").select("page_id", F.col("frame_id").alias("parent_frame_id"), F.lit(True).alias("parent_known"))
    f = frames.join(sorted_side(scanned), ["page_id", "parent_frame_id"], "left")
    s = slots.select("page_id", F.col("frame_id").alias("parent_frame_id"), F.col("slot_idx"), "src", "ord")
    exact = f.where("scanned and self_slot is not null").join(sorted_side(s.withColumnRenamed("slot_idx", "self_slot")), ["page_id", "parent_frame_id", "self_slot"])
    exact = exact.select("page_id", "frame_id", F.col("self_slot").alias("x_slot"), F.col("ord").alias("x_ord"))
    tiered = lambda df, url, keep: df.select(*keep, F.posexplode(F.array(*url_tiers(F.col(url)))).alias("tier", "at")).where(F.col("at").isNotNull())
    wanted = tiered(f.where("parent_frame_id >= 0"), "url", ["page_id", "parent_frame_id", "frame_id"])
    offered = tiered(s, "src", ["page_id", "parent_frame_id", "slot_idx", "ord"])
    hits = wanted.join(sorted_side(offered), ["page_id", "parent_frame_id", "tier", "at"]).groupBy("page_id", "frame_id", "tier").agg(F.count("*").alias("n"), F.min(F.struct("slot_idx", "ord")).alias("slot"))
    first = hits.groupBy("page_id", "frame_id").agg(F.min(F.struct("tier", "n", "slot")).alias("hit"))
    out = f.join(sorted_side(exact), ["page_id", "frame_id"], "left").join(sorted_side(first), ["page_id", "frame_id"], "left")
    method = (
        F.when(F.col("parent_frame_id") < 0, "root").when(F.col("parent_known").isNull(), "parent silent").when(F.col("x_slot").isNotNull(), "frame-element")
        .when(F.col("hit.n") == 1, "src-match").when(F.col("hit.n") > 1, "ambiguous").otherwise("no match")
    )
    out = out.withColumn("method", method)
    pick = lambda a, b: F.when(F.col("method") == "frame-element", F.col(a)).when(F.col("method") == "src-match", F.col(b))
    return out.select("page_id", "frame_id", "method", pick("x_slot", "hit.slot.slot_idx").alias("slot_idx"), pick("x_ord", "hit.slot.ord").alias("ord"))


def nav_frame_rank(frames: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, nav_frame, title_frame): of frames (page_id, frame_id, has_next) the one that owns the next control, by most
    fillable items, then most items, then the lowest id; and the one with most items, else the lowest. items: (page_id, frame_id, manual_only)."""
    counts = items.groupBy("page_id", "frame_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("manual_only"), 0).otherwise(1)).alias("open"))
    f = frames.join(counts, ["page_id", "frame_id"], "left").fillna(0, ["n", "open"])
    nav = F.min(F.when(F.col("has_next"), F.struct((-F.col("open")).alias("o"), (-F.col("n")).alias("m"), "frame_id")))["frame_id"]
    title = F.min(F.struct((-F.col("n")).alias("m"), "frame_id"))["frame_id"]
    return f.groupBy("page_id").agg(nav.alias("nav_frame"), title.alias("title_frame"))


def inaccessible_reasons(frames: DataFrame, scans: DataFrame) -> DataFrame:
    """(page_id, frame_id, reason, retryable) of frames without a scan: the first that holds of sandboxed, load error, no host
    access, timeout, no script. frames: (page_id, frame_id, sandbox, error_occurred, granted, timed_out); granted null: unknown."""
    silent = frames.join(scans.select("page_id", "frame_id").distinct(), ["page_id", "frame_id"], "left_anti")
    boxed = F.col("sandbox").isNotNull() & ~F.array_contains(F.split(F.lower(F.trim("sandbox")), r"\s+"), "allow-scripts")
    reason = (
        F.when(boxed, "sandboxed-without-allow-scripts").when(F.col("error_occurred"), "load-error").when(~F.col("granted"), "no-host-access")
        .when(F.col("timed_out"), "scan-timeout").otherwise("no-content-script")
    )
    return silent.select("page_id", "frame_id", reason.alias("reason"), (~boxed).alias("retryable"))


def coverage_of_frames(reasons: DataFrame) -> DataFrame:
    """(reason, n, retryable) over all pages."""
    return reasons.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.when(F.col("retryable"), 1).otherwise(0)).alias("retryable"))


def removed_frames(known: DataFrame, live: DataFrame) -> DataFrame:
    """Keys (key) that were known and are no longer live."""
    return known.select("key").distinct().join(live.select("key").distinct(), "key", "left_anti")


def retry_set(answers: DataFrame, log: DataFrame) -> DataFrame:
    """answers (question, ...) whose question has a log row (question, outcome) that isn't `filled`."""
    return answers.join(log.where(F.col("outcome") != "filled").select("question").distinct(), "question", "left_semi")


# The order in which outcomes are listed.
OUTCOMES = ("failed", "skipped", "filled")


def fill_outcomes(log: DataFrame) -> DataFrame:
    """(frame, outcome, reason, n, place): log rows (frame, outcome, reason) counted, failed first, then skipped, then filled;
    `place` numbers each frame's rows in that order, larger counts first."""
    counts = log.groupBy("frame", "outcome", "reason").agg(F.count("*").alias("n"))
    rank = F.coalesce(*[F.when(F.col("outcome") == o, F.lit(i)) for i, o in enumerate(OUTCOMES)], F.lit(len(OUTCOMES)))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("frame").orderBy(rank, F.desc("n"), "reason")).cast("long"))


def report_rows(questions: DataFrame, answers: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(form_id, section, q_idx, status, text, place): what a report shows for questions (form_id, section, q_idx, state), in order of
    section and question. answers, suggestions: (form_id, q_idx, value). Conflicts, needs-input, errors and file states show no text."""
    a = answers.select("form_id", "q_idx", F.trim("value").alias("a"))
    s = suggestions.select("form_id", "q_idx", F.trim("value").alias("s"))
    rows = questions.join(a, ["form_id", "q_idx"], "left").join(s, ["form_id", "q_idx"], "left")
    state, told, hint = F.col("state"), F.nullif("a", F.lit("")), F.nullif("s", F.lit(""))
    silent = {"conflict": "conflict", "needs input": "not-in-docs", "error": "error", "ready to attach": "file-ready", "needs file": "file-needed"}
    status = F.coalesce(
        *[F.when(state == k, F.lit(v)) for k, v in silent.items()],
        F.when(state == "from profile", "from-profile"), F.when(state == "draft", "suggested"), F.when(told.isNotNull(), "answered"), F.when(hint.isNotNull(), "suggested"), F.lit("not-in-docs"),
    )
    text = F.when(state.isin(*silent), "").when(state == "from profile", F.coalesce("a", F.lit(""))).when(state == "draft", F.coalesce("s", "a", F.lit(""))).otherwise(F.coalesce(told, hint, F.lit("")))
    place = F.row_number().over(W.partitionBy("form_id").orderBy("section", "q_idx")).cast("long")
    return rows.select("form_id", "section", "q_idx", status.alias("status"), text.alias("text"), place.alias("place"))
