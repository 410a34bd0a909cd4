"""Jobs over pages, URLs and nested items."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..work import sorted_side
from .corpus import numbered


#: What is a URL with a host, and a pattern over such URLs.
URL_PARTS = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)"
PATTERN_PARTS = r"(?i)^(\*|[a-z][a-z0-9+.-]*)://([^/]*)(/.*)?$"


def url_coverage(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct origins of urls (url) that no pattern (pattern) covers: (origin, n).

    Patterns are `scheme://host/path`, with `*` for any scheme or host, `*.suffix` for the suffix and every host under it, `*` in
    paths for anything, no path for all paths, and `<all_urls>`. Ports don't count, other strings cover nothing. URLs without a host are covered: they
    inherit access. A URL meets patterns by equality on (host or suffix, directory): a pattern is kept under the directory that its path
    begins with before the first `*`, so only those whose literal beginning fits are tried as expressions.
    """
    part = lambda c, p, i: F.lower(F.regexp_extract(c, p, i)) if i < 3 else F.regexp_extract(c, p, i)
    host = lambda c, p: F.regexp_replace(part(c, p, 2), r":\d+$", "")
    known = urls.where(F.col("url").rlike(URL_PARTS)).select("url", part("url", URL_PARTS, 1).alias("scheme"), host("url", URL_PARTS).alias("host"), F.regexp_extract("url", URL_PARTS, 3).alias("path"))
    known = known.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    distinct = known.select("scheme", "host", "path").distinct()
    labels, pieces = F.split("host", r"\."), F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    hosts = F.concat(F.array(F.lit("*"), F.col("host")), tails)
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/")))
    each = distinct.select("*", F.explode(hosts).alias("at")).select("*", F.explode(folders).alias("folder"))
    p = patterns.select(F.when(F.col("pattern") == "<all_urls>", "*://*/*").otherwise(F.col("pattern")).alias("pattern")).where(F.col("pattern").rlike(PATTERN_PARTS)).distinct()
    path = F.regexp_extract("pattern", PATTERN_PARTS, 3)
    p = p.select(part("pattern", PATTERN_PARTS, 1).alias("wanted"), host("pattern", PATTERN_PARTS).alias("at"), F.when(path == "", "/*").otherwise(path).alias("glob"))
    literal = F.substring_index("glob", "*", 1)
    folder = F.left(literal, F.length(literal) - F.length(F.substring_index(literal, "/", -1)))
    expression = F.concat(F.lit("(?s)^\\Q"), F.replace("glob", F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))
    p = p.select("wanted", F.regexp_replace("at", r"^\*\.", ".").alias("at"), folder.alias("folder"), expression.alias("expression"))
    covered = each.join(p, ["at", "folder"]).where(((F.col("wanted") == "*") | (F.col("wanted") == F.col("scheme"))) & F.rlike("path", F.col("expression")))
    missing = known.join(covered.select("scheme", "host", "path").distinct(), ["scheme", "host", "path"], "left_anti")
    return missing.groupBy(F.concat("scheme", F.lit("://"), "host").alias("origin")).agg(F.count("*").alias("n"))


def url_language_hint(pages: DataFrame) -> DataFrame:
    """(page_id, language): the bare code of the html tag's lang attribute, null without one."""
    code = F.lower(F.regexp_extract("html", r"<html[^>]*\slang=\"([A-Za-z]{2,3})", 1))
    return pages.select("page_id", F.when(code != "", code).alias("language"))


def hierarchy_splice(nodes: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Depth-first order of a forest of any depth: every node right after its parent and earlier siblings' subtrees.

    nodes: (id, parent, ord), ids unique, roots with a null parent. Returns (id, root, depth, position, note), position within the tree of
    `root`. Siblings follow each other by ord, then id; those without ord come last, noted `unplaced`. A node whose parent isn't there
    is a root, noted `orphan`. Nodes that hang on a cycle have neither root nor position and are noted `cycle`.

    Pointers double: each round a node takes over its pointer's pointer, and those that reach a root drop out, so that depth d takes log2(d)
    rounds of one join of what is left. While a node that leads to a root is left, so was one of half its depth, which drops out; a round in which
    none does leaves only what hangs on cycles. Paths are put together in the same way after that, for the others only. `keep` writes a round's table.
    """
    ids = nodes.select(F.col("id").alias("known"))
    rows = nodes.join(ids, F.col("parent") == F.col("known"), "left").select("id", "parent", "ord", F.col("known").alias("up"))
    rows = keep(rows)
    hops, waiting, before, rounds = rows.where("up is not null").select("id", "up"), None, None, 0
    while True:
        waiting = hops.count()
        if waiting in (0, before):
            break
        step = hops.select(F.col("id").alias("up"), F.col("up").alias("next"))
        hops, before, rounds = keep(hops.join(sorted_side(step), "up").select("id", F.col("next").alias("up"))), waiting, rounds + 1
    cyclic = hops.select("id")
    key = F.array(F.struct(F.col("ord").isNull().alias("unplaced"), F.coalesce("ord", F.lit(0)).alias("ord"), "id"))
    note = F.when(F.col("parent").isNotNull() & F.col("up").isNull(), "orphan").when(F.col("parent").isNotNull() & F.col("ord").isNull(), "unplaced")
    acyclic = rows if waiting == 0 else rows.join(sorted_side(cyclic), "id", "left_anti")
    paths = keep(acyclic.select("id", "up", note.alias("note"), key.alias("path")))
    done, paths = [paths.where("up is null")], paths.where("up is not null")
    above, cols = done[0].unionByName(paths), ["id", "up", "note", "path"]
    for _ in range(rounds):
        if paths.isEmpty():
            break
        step = above.join(sorted_side(paths.select(F.col("up").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        now = keep(paths.join(sorted_side(step), "up").select("id", F.col("next").alias("up"), "note", F.concat("above", "path").alias("path")).select(cols))
        done.append(now.where("up is null"))
        paths = now.where("up is not null")
        above = reduce(DataFrame.unionByName, done).unionByName(paths)
    paths = reduce(DataFrame.unionByName, done)
    rooted = keep(paths.select("id", F.col("path")[0]["id"].alias("root"), (F.size("path") - 1).alias("depth"), "note", "path"))
    placed = numbered(rooted, "root", "path", "position").select("id", "root", "depth", "position", "note")
    lost = rows.join(sorted_side(cyclic), "id", "left_semi").select("id", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("root", "depth", "position")], F.lit("cycle").alias("note"))
    return placed.unionByName(lost)


def reading_order(items: DataFrame, by: str) -> DataFrame:
    """items with `position` within `by`: row bucket of `top` (8 units), then left, then document order; those
    without a place last."""
    order = W.partitionBy(by).orderBy(F.col("top").isNull(), F.round(F.col("top") / 8), F.col("left"), F.col("doc_order"))
    return items.withColumn("position", F.row_number().over(order).cast("long"))
