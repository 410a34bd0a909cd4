"""Matching answers, documents and options to questions: equal keys first, similarity where it must be, refusal on doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..rules import JOIN_WORDS
from ..work import sorted_side
from .facts import plausible
from .similarity import assign, label_pairs

# Least similarity of an answer's label to a question's, and of an attachment's.
LABEL_MATCH, ATTACHMENT_MATCH = 0.55, 0.8
# Keys whose controls are lists of choices.
CHOICE_KEYS = ("dial_code", "dob_day", "dob_month", "dob_year", "country", "state", "gender", "nationality")


def loose(text: Column) -> Column:
    """Lower case without accents; anything but letters and digits as one space."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def canonical(text: Column) -> Column:
    """Loose form without parentheses, with ordinals as numbers and plurals as singulars."""
    out = F.regexp_replace(loose(F.regexp_replace(text, r"\([^)]*\)", " ")), r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    for word, digit in (("first", "1"), ("second", "2"), ("third", "3"), ("fourth", "4"), ("fifth", "5")):
        out = F.regexp_replace(out, rf"\b{word}\b", digit)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(\w)s\b", "$1"), r"\s+", " "))


def acronym(text: Column) -> Column:
    """Initials of the words that aren't JOIN_WORDS; an inner capital begins a word."""
    split = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(loose(split), " "), lambda w: (w != "") & ~w.isin(*JOIN_WORDS))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _has_word(text: Column, part: Column) -> Column:
    around = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (part != "") & F.contains(around(text), around(part))


def best_option(value: Column, options: Column) -> Column:
    """Of an array of options the one that says the same as the value, or null: equal forms, a whole word contained, the
    value's acronym, else the most similar of at least 0.8; the first option on ties. Blank values have none."""
    v, c, short = loose(value), canonical(value), acronym(value)
    first = lambda ok: F.get(F.filter(options, ok), 0)
    equal = first(lambda o: (loose(o) == v) | (canonical(o) == c))
    inside = first(lambda o: (F.length(canonical(o)) >= 3) & (_has_word(c, canonical(o)) | _has_word(canonical(o), c)))
    initials = first(lambda o: (F.length(F.replace(loose(o), F.lit(" "), F.lit(""))) >= 2) & (F.replace(loose(o), F.lit(" "), F.lit("")) == short))
    scored = F.transform(options, lambda o, i: F.struct(tx.similarity(canonical(o), c).alias("s"), (-i).alias("i"), o.alias("o")))
    close = F.array_max(F.filter(scored, lambda x: x["s"] >= 0.8))["o"]
    return F.when(v != "", F.coalesce(equal, inside, initials, close))


def option_choice(values: DataFrame, many: bool = False) -> DataFrame:
    """(id, chosen): the options of each row (id, value, options) that its value stands for.

    With `many`, values are lists (`,` `;` `/` or "and" between) and `chosen` holds every option found, in order, once;
    else it is one option or null. Options are the row's own: nothing is joined.
    """
    if not many:
        return values.select("id", best_option(F.col("value"), F.col("options")).alias("chosen"))
    parts = F.filter(F.transform(F.split("value", r"(?i)[,;/]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.transform(parts, lambda x: best_option(x, F.col("options")))
    return values.select("id", F.array_distinct(F.filter(found, lambda x: x.isNotNull())).alias("chosen"))


def option_exact(values: DataFrame) -> DataFrame:
    """(id, position, strategy) of rows (id, value, options array of (data_value, label)): the first option that equals the
    value by data value, by text, without case, or with white space collapsed; null if none does. Nothing is guessed."""
    bare = lambda x: F.trim(F.coalesce(x, F.lit("")))
    tight = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    want = bare(F.col("value"))
    tests = [
        ("data-value", lambda o: bare(o["data_value"]) == want), ("exact-text", lambda o: bare(o["label"]) == want),
        ("case-insensitive", lambda o: F.lower(bare(o["label"])) == F.lower(want)), ("whitespace-normalized", lambda o: tight(o["label"]) == tight(F.col("value"))),
    ]
    numbered = F.transform("options", lambda o, i: F.struct(i.alias("i"), o["data_value"].alias("data_value"), o["label"].alias("label")))
    rows = values.select("id", "value", numbered.alias("options"))
    hits = [F.get(F.filter("options", ok), 0)["i"] for _, ok in tests]
    strategy = F.coalesce(*[F.when(h.isNotNull(), F.lit(name)) for h, (name, _) in zip(hits, tests, strict=True)])
    out = rows.select("id", F.when(want != "", F.coalesce(*hits)).alias("position"), F.when(want != "", strategy).alias("strategy"))
    return out


def choice_repair(answers: DataFrame) -> DataFrame:
    """Model answers (id, value, options, status) put right against the question's own options: (id, status, value, repaired).

    A JSON array is taken element by element. An answer that is an option stays; one that stands for an option becomes
    it; one that does neither needs input. Without options, blank answers need input and others stay.
    """
    listed = F.col("value").startswith("[")
    each = F.when(listed, F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))
    fixed = F.transform(each, lambda x: F.when(F.array_contains("options", F.trim(x)), F.trim(x)).otherwise(best_option(F.trim(x), F.col("options"))))
    fixed = F.filter(fixed, lambda x: x.isNotNull())
    rows = answers.select("id", "status", F.trim(F.coalesce("value", F.lit(""))).alias("value"), "options")
    rows = rows.withColumn("fixed", F.when((F.size("options") > 0) & (F.col("value") != ""), fixed))
    value = F.when(F.col("status") == "needs_user_input", "").when(F.col("fixed").isNull(), F.col("value")).otherwise(F.array_join("fixed", ", "))
    out = rows.withColumn("now", value)
    changed = F.col("fixed").isNotNull() & (F.col("now") != F.col("value")) & (F.col("now") != "")
    return out.select("id", F.when(F.col("now") == "", "needs_user_input").otherwise(F.col("status")).alias("status"), F.col("now").alias("value"), changed.alias("repaired"))


def profile_match(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Questions (q_id, set_id, key, is_choice, options) answered from facts (set_id, field, value, source, confidence, seq).

    (q_id, key, value, source, outcome). Each fact is the field's best by confidence, first seen on ties. Parts are derived:
    first, middle and last name, day, month and year of birth, dial code. A name of low confidence is withheld. A
    choice never gets a whole phone number. outcome: matched; implausible, no option, no part (each leaves the value to the
    person); no fact. A null key gives `no key`.
    """
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    best = facts.groupBy("set_id", "field").agg(F.min(F.struct((-rank).alias("r"), "seq", "value", "source")).alias("f"))
    best = best.where((F.col("field") != "name") | (F.col("f.r") < -1)).select("set_id", "field", "f.value", "f.source")
    key = F.col("key")
    base = F.when(key.isin("first_name", "middle_name", "last_name"), "name").when(key.isin("dob_day", "dob_month", "dob_year"), "dob").when(key == "dial_code", "phone").otherwise(key)
    q = questions.withColumn("field", base).join(sorted_side(best), ["set_id", "field"], "left")
    words = F.split(F.trim("value"), r"\s+")
    date = lambda i: F.coalesce(
        *[F.when(F.regexp_extract("value", p, 1) != "", F.regexp_extract("value", p, g)) for p, g in ((r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b", (3, 2, 1)[i]), (r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b", (1, 2, 3)[i]))]
    )
    year = F.nullif(F.regexp_extract("value", r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    dial = F.nullif(F.regexp_extract(F.regexp_replace("value", r"[^\d+]", ""), r"^(\+\d{1,3})", 1), F.lit(""))
    part = (
        F.when(key == "first_name", words[0]).when(key == "last_name", F.when(F.size(words) > 1, F.element_at(words, -1)))
        .when(key == "middle_name", F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " "))
        .when(key == "dob_day", date(0)).when(key == "dob_month", date(1)).when(key == "dob_year", F.coalesce(date(2), year))
        .when((key == "dial_code") | ((key == "phone") & F.col("is_choice")), dial).otherwise(F.col("value"))
    )
    asked = F.when((key == "phone") & F.col("is_choice"), "dial_code").otherwise(key)
    q = q.withColumn("part", F.trim(F.coalesce(part, F.lit("")))).withColumn("asked", asked)
    fits = plausible(F.col("asked"), F.col("part"))
    option = best_option(F.col("part"), F.col("options"))
    constrained = F.col("is_choice") & (F.size("options") > 0)
    outcome = (
        F.when(key.isNull(), "no key").when(F.col("part") == "", F.when(F.col("value").isNotNull() | (F.col("is_choice") & key.isin(*CHOICE_KEYS)), "no part").otherwise("no fact"))
        .when(~fits, "implausible").when(constrained & option.isNull(), "no option").otherwise("matched")
    )
    q = q.withColumn("outcome", outcome)
    value = F.when(F.col("outcome") == "matched", F.when(constrained, option).otherwise(F.col("part")))
    return q.select("q_id", F.col("asked").alias("key"), value.alias("value"), F.when(F.col("outcome") == "matched", F.col("source")).alias("source"), "outcome")


def document_match(questions: DataFrame, files: DataFrame, words: DataFrame, prefix: int = 4000) -> DataFrame:
    """(q_id, file_name, confidence): for upload questions (q_id, set_id, label) the best file (set_id, file_name, text).

    words: (key, word), see rules.document_words. A word asked for counts 3 in the file's name, else 1 in its first `prefix`
    characters; a label's word of four letters and more in the name counts 1. 3 points are high, 1 medium; a set's only
    file is offered as low. Files are scored against the few words once, and questions meet the hits by word: no
    question meets every file of its set.
    """
    distinct = questions.select("label").distinct()
    all_words = words.select("key", "word").distinct()
    triggers = words.select("key", F.explode(F.array("key", "word")).alias("trigger")).distinct()
    asked = distinct.join(F.broadcast(triggers), F.contains(F.lower("label"), F.col("trigger"))).select("label", "key").distinct()
    asked = asked.join(all_words, "key").select("label", "word").distinct()
    name, head = F.lower("file_name"), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, prefix))
    vocabulary = F.broadcast(words.select("word").distinct())
    hits = files.select("set_id", "file_name", name.alias("name"), head.alias("head")).join(vocabulary, F.contains("name", "word") | F.contains("head", "word"))
    hits = hits.select("set_id", "file_name", "word", F.when(F.contains("name", "word"), 3).otherwise(1).alias("points"))
    own = F.filter(F.split(F.lower("label"), r"\W+"), lambda w: F.length(w) >= 4)
    parts = F.explode(F.array_distinct(F.split(name, r"[^\p{L}\p{N}]+"))).alias("part")
    named = files.select("set_id", "file_name", parts)
    q = questions.select("q_id", "set_id", "label")
    by_name = q.select("q_id", "set_id", F.explode(F.array_distinct(own)).alias("part")).join(named, ["set_id", "part"]).select("q_id", "file_name", F.lit(1).alias("points"))
    by_word = q.join(asked, "label").join(hits, ["set_id", "word"]).select("q_id", "file_name", "points")
    scored = by_word.unionByName(by_name).groupBy("q_id", "file_name").agg(F.sum("points").alias("score"))
    best = scored.groupBy("q_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "file_name")).alias("b"))
    only = files.groupBy("set_id").agg(F.min("file_name").alias("only"), F.max("file_name").alias("last")).where("only = last").select("set_id", "only")
    out = q.join(best, "q_id", "left").join(only, "set_id", "left")
    found = F.when(F.col("b").isNotNull(), F.col("b.file_name")).otherwise(F.col("only"))
    confidence = F.when(F.col("b.s") <= -3, "high").when(F.col("b").isNotNull(), "medium").when(F.col("only").isNotNull(), "low")
    return out.select("q_id", found.alias("file_name"), confidence.alias("confidence"))


def attachment_plan(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """(q_id, file_name, plan): uploads (q_id, mode) with their matched file: attach in automatic mode, by hand in manual
    mode, missing without a file."""
    joined = questions.select("q_id", "mode").join(matches.select("q_id", "file_name"), "q_id", "left")
    plan = F.when(F.col("mode") == "manual", "by hand").when(F.col("file_name").isNull(), "missing").otherwise("attach")
    return joined.select("q_id", "file_name", plan.alias("plan"))


def upload_accepts(files: DataFrame) -> DataFrame:
    """(id, accepted) of rows (id, file_name, mime, accept): whether the file satisfies the list (`.ext`, `type/*`, or a whole
    MIME type); an empty list takes all."""
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce("accept", F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    name, mime = F.lower("file_name"), F.lower(F.coalesce("mime", F.lit("")))
    ok = lambda t: F.when(t.startswith("."), F.endswith(name, t)).when(t.endswith("/*"), F.startswith(mime, F.left(t, F.length(t) - 1))).otherwise(mime == t)
    return files.select("id", ((F.size(tokens) == 0) | F.exists(tokens, ok)).alias("accepted"))


def nav_label_join(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels (label) with kind and language of the longest navigation label that they equal or begin with (as words).

    rules: (language, kind, label, ord), see rules.nav_labels; the first declared wins ties; null where none fits. A
    label meets rules on its own leading words, so the join is an equality on distinct labels.
    """
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy")), r"\s+", " "))
    rules = rules.select("language", "kind", "ord", tidy(F.col("label")).alias("rule"))
    longest = rules.agg(F.max(F.size(F.split("rule", " ")))).first()[0] or 1  # of a vocabulary
    distinct = labels.select("label").distinct().withColumn("words", F.split(tidy(F.col("label")), " "))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words"))), lambda n: F.array_join(F.slice("words", 1, n), " "))
    hits = distinct.select("label", F.explode(heads).alias("rule")).join(rules, "rule")
    best = hits.groupBy("label").agg(F.min(F.struct((-F.length("rule")).alias("l"), "ord", "kind", "language")).alias("b"))
    return labels.join(best, "label", "left").select(*labels.columns, F.col("b.kind").alias("kind"), F.col("b.language").alias("language"))


# Similarity of labels


def identity_match(questions: DataFrame, answers: DataFrame, keep) -> DataFrame:
    """(form_id, a_id, q_id, how) of answers (form_id, a_id, label, value, identity_key, invalidated) and questions
    (form_id, q_id, label, identity_key): one row for each answer with text.

    `key`: the first question of the structural key, the first answer that claims it. `label`: an invalidated answer whose
    label resembles exactly one free question's (two answers of one question: the first). `refused`: an invalidated answer that
    resembles none or several. `similar`: all others by greedy assignment. `none`: no question.
    """
    told = answers.where(F.trim(F.coalesce("value", F.lit(""))) != "").drop("value")
    firsts = questions.where(F.col("identity_key").isNotNull()).groupBy("form_id", "identity_key").agg(F.min("q_id").alias("q_id"))
    keyed = told.where(F.col("identity_key").isNotNull()).join(firsts, ["form_id", "identity_key"]).groupBy("form_id", "q_id").agg(F.min("a_id").alias("a_id"))
    keyed = keep(keyed.select("form_id", "a_id", "q_id", F.lit("key").alias("how")))
    free = keep(questions.join(keyed.select("form_id", "q_id"), ["form_id", "q_id"], "left_anti"))
    rest = keep(told.join(keyed.select("form_id", "a_id"), ["form_id", "a_id"], "left_anti"))
    side = lambda df, i: df.select(F.col("form_id").alias("block"), F.col(i).alias("id"), "label")
    pairs = keep(label_pairs(side(rest, "a_id"), side(free, "q_id"), LABEL_MATCH))
    lost = rest.where("invalidated").select(F.col("form_id").alias("block"), F.col("a_id").alias("a"))
    seen = lost.join(pairs, ["block", "a"], "left").groupBy("block", "a").agg(F.count("b").alias("n"), F.min("b").alias("b"))
    sole = seen.where("n = 1").groupBy("block", "b").agg(F.min("a").alias("a"))
    by_label = keep(sole.select(F.col("block").alias("form_id"), F.col("a").alias("a_id"), F.col("b").alias("q_id"), F.lit("label").alias("how")))
    refused = lost.select(F.col("block").alias("form_id"), F.col("a").alias("a_id")).join(by_label.select("form_id", "a_id"), ["form_id", "a_id"], "left_anti")
    refused = refused.select("form_id", "a_id", F.lit(None).cast(questions.schema["q_id"].dataType).alias("q_id"), F.lit("refused").alias("how"))
    open_pairs = pairs.join(lost, ["block", "a"], "left_anti").join(by_label.select(F.col("form_id").alias("block"), F.col("q_id").alias("b")), ["block", "b"], "left_anti")
    similar = assign(open_pairs, keep).select(F.col("block").alias("form_id"), F.col("a").alias("a_id"), F.col("b").alias("q_id"), F.lit("similar").alias("how"))
    out = keyed.unionByName(by_label).unionByName(refused).unionByName(similar)
    none = told.select("form_id", "a_id").join(out.select("form_id", "a_id"), ["form_id", "a_id"], "left_anti")
    return out.unionByName(none.select("form_id", "a_id", F.lit(None).cast(questions.schema["q_id"].dataType).alias("q_id"), F.lit("none").alias("how")))


def attachment_match(questions: DataFrame, attachments: DataFrame) -> DataFrame:
    """(q_id, a_id): for upload questions (form_id, q_id, label) the attachment (form_id, a_id, label) whose label is most
    similar, if by ATTACHMENT_MATCH at least; the first on ties; null if none is."""
    side = lambda df, i: df.select(F.col("form_id").alias("block"), F.col(i).alias("id"), "label")
    pairs = label_pairs(side(questions, "q_id"), side(attachments, "a_id"), ATTACHMENT_MATCH)
    best = pairs.groupBy("block", "a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b"))["b"].alias("a_id"))
    return questions.join(best.select(F.col("block").alias("form_id"), F.col("a").alias("q_id"), "a_id"), ["form_id", "q_id"], "left").select("form_id", "q_id", "a_id")


def evidence_gate(evidence: DataFrame, answers: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Answers (answer_id, status, value, confidence) after their evidence (answer_id, source, value, seq) was looked at.

    Only evidence from a file (a name with an extension) is cited. An answer without any needs input; one whose evidence
    says different things (see evidence_agreement, also for `links`) is in conflict; files that agree raise the confidence; blank values need input.
    """
    from .questions import evidence_agreement

    cited = evidence.where(F.trim(F.coalesce("source", F.lit(""))).rlike(r"\.[A-Za-z0-9]{2,5}$"))
    told = evidence_agreement(cited, links).select("answer_id", "agree", "files")
    rows = answers.join(sorted_side(told), "answer_id", "left")
    empty = (F.col("status") == "needs_user_input") | (F.trim(F.coalesce("value", F.lit(""))) == "") | F.col("files").isNull()
    status = F.when(empty, "needs_user_input").when(~F.col("agree"), "conflicting_sources").otherwise(F.col("status"))
    confidence = F.when(F.col("agree") & (F.col("files") > 1), "high").otherwise(F.coalesce("confidence", F.lit("low")))
    return rows.select("answer_id", status.alias("status"), F.when(empty, "").otherwise(F.col("value")).alias("value"), confidence.alias("confidence"), F.coalesce("files", F.lit(0)).alias("files"))


def cited_files(evidence: DataFrame) -> DataFrame:
    """(answer_id, n, files): distinct file names that an answer's evidence cites, in order, joined by a comma."""
    cited = evidence.where(F.trim(F.coalesce("source", F.lit(""))).rlike(r"\.[A-Za-z0-9]{2,5}$")).select("answer_id", F.trim("source").alias("source")).distinct()
    return cited.groupBy("answer_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("files"))


def compose_validate(drafts: DataFrame, leaked: str) -> DataFrame:
    """Composed drafts (id, draft, drafts, not_found, seed_used, seed) that may be shown: (id, outcome, draft, variants, seed_used).

    Drafts that are blank, not found or match `leaked` (they talk about themselves) are invalid and lose their
    variants. Variants are the draft and the distinct others that hold up, if more than one was sent.
    """
    draft = F.trim(F.coalesce("draft", F.lit("")))
    bad = F.coalesce("not_found", F.lit(False)) | (draft == "") | draft.rlike(leaked)
    kept = F.filter(F.transform(F.coalesce("drafts", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & ~x.rlike(leaked))
    variants = F.when(~bad & (F.size(kept) > 1), F.array_distinct(F.concat(F.array(draft), kept))).otherwise(F.array().cast("array<string>"))
    seeded = ~bad & F.coalesce("seed_used", F.lit(False)) & (F.trim(F.coalesce("seed", F.lit(""))) != "")
    return drafts.select("id", F.when(bad, "not found").otherwise("draft").alias("outcome"), F.when(bad, "").otherwise(draft).alias("draft"), variants.alias("variants"), seeded.alias("seed_used"))
