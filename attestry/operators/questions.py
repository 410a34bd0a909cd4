"""Jobs that resolve question tables: rules joined to labels, tiers of answers, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import plain_words, similarity
from ..rules import JOIN_WORDS
from ..work import counted_side, sorted_side, spread, written
from .similarity import similar_labels

#: Patterns of declarations, in the order in which the first match wins.
DECLARATIONS = [
    ("disciplinary", r"(?i)disciplinar|misconduct|dismissed for|terminated for cause|separated from service"),
    ("investigation_criminal", r"(?i)investigat|charged with|convicted|criminal (record|offen[cs]e|charge)|arrested|pending (charge|case)"),
    ("relatives_employed", r"(?i)relative[s]?\b.*(employ|work)|family member[s]?\b.*(employ|work)|related to.*(staff|employee|personnel)"),
    ("conflict_of_interest", r"(?i)conflict of interest"),
    ("reference_consent", r"(?i)reference check|contact.*referee|object.*(reference|referee)|verify.*reference"),
    ("willing_assignment", r"(?i)willing to (accept|be assigned|relocate|travel|serve)|accept.*(assignment|duty station)|available to travel"),
    ("certification", r"(?i)i (hereby )?(certify|declare|confirm|attest)|certif(y|ication) that the (above|information|statements)|declaration of|i understand that any (misrepresentation|false)"),
]
#: Words of open questions, and of questions for one value.
OPEN_HINTS = "describe|explain|why|motivation|objective|experience|tell us|about yourself|goals|statement|essay|reason|background|achievement|strength|challenge|contribution|plan|elaborate|discuss"
DISCRETE_HINTS = "id number|id no|identification|passport|phone|mobile|email|e-mail|date of birth|dob|zip|postal|postcode|ssn|tax|account number|url|website|first name|last name|full name"


#: Up to so many keywords are held by every task.
VOCABULARY = 10_000
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def semantic_key_join(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """questions with `key`: of the keywords that the label contains the longest, the first declared on a tie; null without any.

    keywords: (key, keyword, ord), a rule table. Labels and keywords are compared in lower case, without accents and with
    single spaces. Only distinct labels meet the keywords; the argmax is aggregated.
    """
    tidy = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\s+", " "))
    labels = questions.select("label").distinct().withColumn("low", tidy(F.col("label")))
    rules = keywords.select("key", tidy(F.col("keyword")).alias("keyword"), "ord").where("keyword <> ''")
    few = rules.limit(VOCABULARY + 1).count() <= VOCABULARY
    if few:
        hits = labels.join(F.broadcast(rules), F.contains(F.col("low"), F.col("keyword")))
    else:  # a large vocabulary meets the pieces of a label that are as long as some keyword, by equality
        widths = F.array(*[F.lit(r[0]) for r in rules.select(F.length("keyword")).distinct().collect()])  # as many as lengths
        pieces = F.flatten(F.transform(widths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1))), lambda i: F.substring(F.col("low"), i, n))))
        hits = labels.select("label", F.explode(F.array_distinct(pieces)).alias("keyword")).join(rules, "keyword")
    best = hits.groupBy("label").agg(F.min(F.struct((-F.length("keyword")).alias("l"), "ord", "key"))["key"].alias("key"))
    return questions.join(best, "label", "left")


def declaration_kind(label: Column) -> Column:
    return F.coalesce(*[F.when(label.rlike(p), F.lit(kind)) for kind, p in DECLARATIONS])


def composable(kind: Column, label: Column, manual_only: Column) -> Column:
    """Whether a draft may be written: any paragraph, or a short answer that asks openly and for no single value."""
    low = F.lower(label)
    short = (kind == "short_answer") & low.rlike(OPEN_HINTS) & ~low.rlike(DISCRETE_HINTS)
    return ~manual_only & ((kind == "paragraph") | short)


def resolution_waterfall(questions: DataFrame, facts: DataFrame, defaults: DataFrame, supplied: DataFrame) -> DataFrame:
    """(form_id, q_idx, tier, answer): the first tier that has an answer.

    manual (no answer is sought), 0 facts by (set_id, key), 1 declarations by kind, 2 supplied answers with a
    cited file, file (uploads), else needs input. questions: (form_id, q_idx, set_id, key, label, kind,
    manual_only); facts: (set_id, key, value, confidence), the best is taken; defaults: (declaration, value);
    supplied: (form_id, q_idx, value, source).
    """
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    best = facts.groupBy("set_id", "key").agg(F.max(F.struct(rank.alias("r"), "value"))["value"].alias("fact"))
    cited = supplied.where(F.col("source").rlike(r"\.[A-Za-z0-9]{2,5}$") & (F.trim("value") != "")).select("form_id", "q_idx", F.col("value").alias("given"))
    open_ = questions.withColumn("declaration", declaration_kind(F.col("label")))
    joined = (
        open_.join(best, ["set_id", "key"], "left")
        .join(F.broadcast(defaults.select("declaration", F.col("value").alias("default"))), "declaration", "left")
        .join(cited, ["form_id", "q_idx"], "left")
    )
    tier = (
        F.when(F.col("manual_only"), "manual").when(F.col("fact").isNotNull(), "facts").when(F.col("default").isNotNull(), "declaration")
        .when(F.col("given").isNotNull(), "supplied").when(F.col("kind") == "file", "file").otherwise("needs input")
    )
    answer = F.when(F.col("manual_only"), None).otherwise(F.coalesce("fact", "default", "given"))
    return joined.select("form_id", "q_idx", tier.alias("tier"), answer.alias("answer"))


# The longest acronym, and how near to its expansion a text writes an acronym that it links.
ACRONYM, LINK_WINDOW = 6, 80


def _said(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}+@]+", " "))


def _initials(value: Column) -> Column:
    """First letters of the words that join no others, without what stands in parentheses."""
    words = F.filter(F.split(_said(F.regexp_replace(value, r"\([^)]*\)", " ")), " "), lambda w: (w != "") & ~w.isin(*JOIN_WORDS))
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def acronym_links(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, link): pairs `acronym|expansion` among the values of an answer (answer_id, set_id, value) that a document of its set links.

    A document (set_id, file_name, text) links them if it has the acronym as a word within LINK_WINDOW characters of the expansion, without regard to
    case. Documents are found by the rarest of these words in their set, by a join on (set_id, word); of theirs only the texts that hold all of them
    are searched.
    """
    said = F.struct("set_id", _said(F.col("value")).alias("n"), _initials(F.col("value")).alias("initials"), F.trim(F.lower(F.regexp_replace("value", r"\s+", " "))).alias("phrase"))
    told = spread(evidence.where(F.col("value").isNotNull()).select("answer_id", "set_id", "value"), "answer_id").groupBy("answer_id").agg(F.collect_set(said).alias("said"))
    short = F.transform(F.filter("said", lambda x: ~F.contains(x["n"], F.lit(" ")) & F.length(x["n"]).between(1, ACRONYM)), lambda x: x["n"])
    long = F.filter("said", lambda x: F.contains(x["n"], F.lit(" ")) & F.array_contains("short", x["initials"]))
    pairs = told.withColumn("short", short).select("answer_id", F.explode(long).alias("x"))
    pairs = written(pairs.select("answer_id", "x.set_id", F.col("x.initials").alias("acronym"), F.col("x.n").alias("expansion"), "x.phrase"), "pairs")
    key = ["set_id", "acronym", "expansion", "phrase"]
    needed = F.array_distinct(F.concat(F.array("acronym"), F.split("expansion", " ")))
    wanted = written(pairs.select(*key).distinct().withColumn("needed", needed), "wanted")
    held = documents.select("set_id", "file_name", F.explode(F.array_distinct(F.split(_said(F.coalesce("text", F.lit(""))), " "))).alias("word"))
    counts = held.groupBy("set_id", "word").agg(F.count("*").alias("n"))
    words = wanted.select(*key, F.size("needed").alias("n_words"), F.explode("needed").alias("word")).join(sorted_side(counts), ["set_id", "word"])
    rare = words.groupBy(*key, "n_words").agg(F.count("*").alias("met"), F.min(F.struct("n", "word"))["word"].alias("word")).where("met = n_words").select(*key, "word")
    files = held.join(counted_side(written(rare, "rare")), ["set_id", "word"]).select("file_name", *key)
    around = F.concat(F.lit("(?s)\\b"), F.col("acronym"), F.lit("\\b.{0,"), (F.lit(LINK_WINDOW) - F.length("acronym")).cast("string"), F.lit("}\\Q"), F.col("phrase"), F.lit("\\E|\\Q"), F.col("phrase"), F.lit("\\E.{0,"), (F.lit(LINK_WINDOW) - F.length("acronym")).cast("string"), F.lit("}\\b"), F.col("acronym"), F.lit("\\b"))
    texts = documents.select("set_id", "file_name", F.lower("text").alias("text"), F.split(_said(F.col("text")), " ").alias("words"))
    spelt = F.forall(F.array_distinct(F.concat(F.array("acronym"), F.split("expansion", " "))), lambda w: F.array_contains("words", w))
    near = F.when(spelt, F.rlike("text", around)).otherwise(False)
    found = texts.join(sorted_side(files), ["set_id", "file_name"]).where(near).select(*key).distinct()
    linked = pairs.join(counted_side(written(found, "found")), key).groupBy("answer_id").agg(F.collect_set(F.concat_ws("|", "acronym", "expansion")).alias("links"))
    return linked.select("answer_id", F.explode("links").alias("link"))


def evidence_agreement(evidence: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(answer_id, agree, value, files): whether an answer's evidence says one thing.

    Values are taken in order; equal or contained ones (without marks and case) are the same, the longest spelling stays. So are an acronym
    and what it stands for, if all that says either is one file or if `links` (see acronym_links) has them: initials alone
    may be of two things. More than one group is a conflict. Blank values say nothing. evidence: (answer_id, seq, source, value).
    """
    entry = F.struct("seq", _said(F.col("value")).alias("n"), "value", _initials(F.col("value")).alias("initials"), F.array(F.col("source").cast("string")).alias("files"))
    rows = spread(evidence.select("answer_id", "seq", "source", "value"), "answer_id").where(_said(F.coalesce("value", F.lit(""))) != "").select("answer_id", entry.alias("e"))
    # counted in the list: a distinct count beside it would collect and shuffle the lists once for each source
    told = rows.groupBy("answer_id").agg(F.sort_array(F.collect_list("e")).alias("said"))
    told = told.withColumn("files", F.size(F.array_distinct(F.array_compact(F.transform("said", lambda x: x["files"][0])))).cast("long"))
    none = F.array().cast("array<string>")
    if links is None:
        told = told.withColumn("links", none)
    else:
        told = told.join(links.groupBy("answer_id").agg(F.collect_list("link").alias("links")), "answer_id", "left").withColumn("links", F.coalesce("links", none))
    seq = evidence.schema["seq"].dataType.simpleString()

    def stands_for(short: Column, long: Column, one_file: Column) -> Column:
        fits = ~F.contains(short["n"], F.lit(" ")) & (F.length(short["n"]) <= ACRONYM) & (long["initials"] == short["n"])
        return fits & (one_file | F.array_contains("links", F.concat_ws("|", short["n"], long["n"])))

    def same(g: Column, e: Column) -> Column:
        one_file = (F.size(g["files"]) == 1) & (g["files"][0] == e["files"][0])
        return F.contains(g["n"], e["n"]) | F.contains(e["n"], g["n"]) | stands_for(g, e, one_file) | stands_for(e, g, one_file)

    def merged(g: Column, e: Column) -> Column:
        longer = F.length(e["n"]) > F.length(g["n"])
        pick = lambda c: F.when(longer, e[c]).otherwise(g[c]).alias(c)
        return F.struct(g["seq"].alias("seq"), pick("n"), pick("value"), pick("initials"), F.array_union(g["files"], e["files"]).alias("files"))

    def fold(groups: Column, e: Column) -> Column:
        first = F.array_position(F.transform(groups, lambda g: same(g, e)), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == first, merged(g, e)).otherwise(g))
        return F.when(first > 0, joined).otherwise(F.concat(groups, F.array(e)))

    folded = F.aggregate("said", F.array().cast(f"array<struct<seq:{seq},n:string,value:string,initials:string,files:array<string>>>"), fold)
    out = told.withColumn("groups", folded)
    return out.select("answer_id", (F.size("groups") <= 1).alias("agree"), F.when(F.size("groups") == 1, F.col("groups")[0]["value"]).alias("value"), "files")


def commit_reviews(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored answers with non-blank reviewed values that differ put in their place: (form_id, q_idx, value, committed)."""
    r = reviews.where(F.trim("value") != "").select("form_id", "q_idx", F.col("value").alias("reviewed"))
    joined = stored.join(r, ["form_id", "q_idx"], "full_outer")
    changed = F.col("reviewed").isNotNull() & ~F.col("reviewed").eqNullSafe(F.col("value"))
    return joined.select("form_id", "q_idx", F.coalesce("reviewed", "value").alias("value"), changed.alias("committed"))


def budget_cut(questions: DataFrame, budget: int) -> DataFrame:
    """questions with `sent`: the first `budget` of each form go, the rest wait."""
    return questions.withColumn("sent", F.row_number().over(W.partitionBy("form_id").orderBy("q_idx")) <= budget)


def fillable_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers (form_id, q_idx, value) with text whose question isn't for the person alone."""
    free = questions.where(~F.col("manual_only")).select("form_id", "q_idx")
    return answers.where(F.trim(F.coalesce("value", F.lit(""))) != "").join(free, ["form_id", "q_idx"], "left_semi")


def unresolved_questions(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Questions that still need an answer from elsewhere: no uploads, no grids, none for the person alone, none resolved."""
    return questions.where(~F.col("manual_only") & ~F.col("kind").isin("file", "file_upload", "multiple_choice_grid", "checkbox_grid")).join(resolved.select("form_id", "q_idx"), ["form_id", "q_idx"], "left_anti")


def boundary_leak_check(outgoing: DataFrame, questions: DataFrame) -> DataFrame:
    """outgoing, unless it holds a question for the person alone: then reading it fails."""
    own = questions.where("manual_only").select("form_id", "q_idx", F.lit(True).alias("own"))
    checked = outgoing.join(own, ["form_id", "q_idx"], "left")
    failed = F.when(F.col("own"), F.raise_error(F.concat(F.lit("manual-only question goes out: "), F.col("form_id").cast("string")))).otherwise(F.lit(True))
    return checked.withColumn("ok", failed.cast("boolean")).where("ok").drop("ok", "own")


def placeholder_options(options: DataFrame) -> DataFrame:
    """(id, kept): option lists without prompts such as "Select...", "--" or marks alone."""
    prompt = lambda x: F.trim(x).rlike(r"(?i)^(select|choose|please select|pick)\b.*$|^[\p{P}\s]*$")
    return options.select("id", F.filter("options", lambda x: ~prompt(x)).alias("kept"))


def option_resolve(values: DataFrame, options: DataFrame, least: float = 0.8) -> DataFrame:
    """values (id, set_id, value) to one of their set's own options (set_id, pos, option), or null.

    Tiers: equal without marks and case, contained as whole words (3 characters or more), similar by at least
    `least`; the lowest tier wins, then the score, then the first option. Each tier is a join on equality: of the forms, of runs of
    words no longer than what they could hold or be held by, and, for values that have neither, of tiles (see similarity).
    """
    # Distinct values meet distinct options of their set; rows are joined back after that.
    v = values.select("set_id", plain_words(F.col("value")).alias("v")).where("v <> ''").distinct()
    o = options.groupBy("set_id", plain_words(F.col("option")).alias("o")).agg(F.min(F.struct("pos", "option")).alias("p")).where("o <> ''")
    o = o.select("set_id", "o", "p.pos", "p.option")
    score = lambda: F.round(similarity(F.col("v"), F.col("o")), 6)
    equal = v.join(o.withColumn("v", F.col("o")), ["set_id", "v"]).select("set_id", "v", "pos", "option", F.lit(1).alias("tier"), F.lit(-1.0).alias("worse"))
    within = _runs(v, "v", o, "o").join(o, ["set_id", "o"]).unionByName(_runs(o, "o", v, "v").join(o, ["set_id", "o"]))
    within = within.where("v <> o").select("set_id", "v", "pos", "option", F.lit(2).alias("tier"), (-score()).alias("worse"))
    found = equal.unionByName(within)
    rest = v.join(found.select("set_id", "v").distinct(), ["set_id", "v"], "left_anti")
    side = lambda df, c: df.select(F.col("set_id").alias("block"), F.col(c).alias("label"))
    close = similar_labels(side(rest, "v"), side(o, "o"), least).select(F.col("block").alias("set_id"), F.col("la").alias("v"), F.col("lb").alias("o"), (-F.col("score")).alias("worse"))
    close = close.join(o, ["set_id", "o"]).select("set_id", "v", "pos", "option", F.lit(3).alias("tier"), "worse")
    best = found.unionByName(close).groupBy("set_id", "v").agg(F.min(F.struct("tier", "worse", "pos", "option")).alias("b"))
    return values.withColumn("v", plain_words(F.col("value"))).join(best, ["set_id", "v"], "left").select("id", F.col("b.option").alias("option"), F.col("b.tier").alias("tier"))


def _runs(long: DataFrame, name: str, short: DataFrame, inner: str) -> DataFrame:
    """(set_id, name, inner): labels of `long` with those of `short` that stand in them as whole words, of 3 characters or more."""
    sizes = short.where(F.length(inner) >= 3).select("set_id", F.size(F.split(inner, " ")).alias("n")).distinct()
    words = long.select("set_id", name, F.split(name, " ").alias("words")).join(sizes, "set_id").where(F.size("words") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    runs = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("n")), " ")))
    return words.select("set_id", name, F.explode(runs).alias(inner)).join(short.where(F.length(inner) >= 3).select("set_id", inner), ["set_id", inner])
