"""Dossiers and model output as JSON: flattening, counting, contracts and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "array<struct<key:string,value:string,source_filename:string,confidence:string>>"


def dossier_long(sections: DataFrame) -> DataFrame:
    """(set_id, section, key, value, source_filename, confidence) of sections (set_id, section, body JSON).

    A body is an array of key/value entries or an object of sourced values. Values are trimmed, blank ones and keyless
    entries go; a missing source is `(unattributed)`, a missing confidence low. Anything else has no rows. The last
    entry of a key stays.
    """
    listed = F.from_json("body", ENTRY)
    keyed = F.from_json("body", "map<string,struct<value:string,source_filename:string,confidence:string>>")
    as_list = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"), e["value"]["source_filename"].alias("source_filename"), e["value"]["confidence"].alias("confidence")))
    entries = F.when(F.ltrim("body").startswith("["), listed).otherwise(as_list)
    rows = sections.select("set_id", "section", F.posexplode(entries).alias("at", "e"))
    rows = rows.where((F.trim("e.value") != "") & (F.coalesce("e.key", F.lit("")) != ""))
    last = rows.groupBy("set_id", "section", F.col("e.key").alias("key")).agg(F.max(F.struct("at", "e"))["e"].alias("e"))
    return last.select(
        "set_id", "section", "key", F.trim("e.value").alias("value"), F.coalesce("e.source_filename", F.lit("(unattributed)")).alias("source_filename"), F.coalesce("e.confidence", F.lit("low")).alias("confidence")
    )


def fact_counts(long: DataFrame, nested: DataFrame) -> DataFrame:
    """(set_id, scalar, nested, facts): keys of the long form, and keys of the nested entries (set_id, entry map) of a set."""
    a = long.groupBy("set_id").agg(F.count("*").alias("scalar"))
    b = nested.groupBy("set_id").agg(F.sum(F.size(F.map_keys("entry"))).alias("nested"))
    both = a.join(b, "set_id", "full_outer").fillna(0, ["scalar", "nested"])
    return both.select("set_id", "scalar", "nested", (F.col("scalar") + F.col("nested")).alias("facts"))


def _kind(value: Column) -> Column:
    """number, string, boolean, array, object or null of a VARIANT; missing if there is none."""
    told = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing").when(told == "VOID", "null").when(told.startswith("ARRAY"), "array").when(told.startswith("OBJECT"), "object")
        .when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").otherwise("number")
    )


def contract_issues(outputs: DataFrame) -> DataFrame:
    """(id, path, problem): what answers (id, answers JSON) lack or mistype.

    Each answer is an object with a number question_id, a string value and an array of evidence (an empty one is right); each
    piece of evidence an object with the strings dossier_path, source_filename, snippet and implied_value.
    """
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    issue = lambda path, problem: F.struct(path.alias("path"), problem.alias("problem"))
    wrong = lambda v, path, want: F.when(_kind(v) != want, issue(path, F.concat(F.lit(f"expected {want}, got "), _kind(v))))
    whole = outputs.select("id", F.try_parse_json("answers").alias("v"))
    top = whole.where(F.coalesce(_kind(F.col("v")) != "array", F.lit(True))).select("id", F.lit("answers").alias("path"), F.concat(F.lit("expected array, got "), _kind(F.col("v"))).alias("problem"))
    each = whole.select("id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "a")).withColumn("at", F.concat(F.lit("answers["), "i", F.lit("]")))
    of = lambda name: F.concat("at", F.lit(f".{name}"))
    a = F.col("a")
    told = F.when(_kind(a) != "object", F.array(issue(F.col("at"), F.lit("not an object")))).otherwise(
        F.array(wrong(field(a, "question_id"), of("question_id"), "number"), wrong(field(a, "value"), of("value"), "string"), wrong(field(a, "evidence"), of("evidence"), "array"))
    )
    answers = each.select("id", F.explode(told).alias("x")).where("x is not null").select("id", "x.path", "x.problem")
    proof = each.select("id", "at", F.posexplode(F.try_variant_get("a", "$.evidence", "array<variant>")).alias("j", "e")).withColumn("at", F.concat("at", F.lit(".evidence["), "j", F.lit("]")))
    e = F.col("e")
    fields = ("dossier_path", "source_filename", "snippet", "implied_value")
    lacks = F.when(_kind(e) != "object", F.array(issue(F.col("at"), F.lit("not an object")))).otherwise(
        F.array(*[F.when(field(e, n).isNull(), issue(of(n), F.lit("missing"))).otherwise(wrong(field(e, n), of(n), "string")) for n in fields])
    )
    evidence = proof.select("id", F.explode(lacks).alias("x")).where("x is not null").select("id", "x.path", "x.problem")
    return top.unionByName(answers).unionByName(evidence)


def shape_paths(documents: DataFrame, keep) -> DataFrame:
    """(id, path, kind) of every node of documents (id, body JSON); arrays' elements by position. Level by level: as many rounds as
    the deepest document has levels; `keep(df)` writes a level, so that lineage stays short."""
    level = keep(documents.select("id", F.lit("#").alias("path"), F.try_parse_json("body").alias("v")))
    out = level.select("id", "path", _kind(F.col("v")).alias("kind"))
    while not level.where(_kind(F.col("v")).isin("object", "array")).isEmpty():
        objects = level.where(_kind(F.col("v")) == "object").select("id", "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v"))
        arrays = level.where(_kind(F.col("v")) == "array").select("id", "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("k", "v"))
        level = keep(
            objects.select("id", F.concat("path", F.lit("."), "k").alias("path"), "v").unionByName(arrays.select("id", F.concat("path", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("path"), "v"))
        )
        out = out.unionByName(level.select("id", "path", _kind(F.col("v")).alias("kind")))
    return out


def shape_diff(left: DataFrame, right: DataFrame, keep) -> DataFrame:
    """(id, path, problem) where two documents (id, body JSON) of one id differ in shape: members on one side only, or of another
    kind. What lies below such a path isn't compared; arrays are compared as far as both reach; contents are not."""
    a = shape_paths(left, keep).withColumnsRenamed({"kind": "ka"})
    b = shape_paths(right, keep).withColumnsRenamed({"kind": "kb"})
    both = a.join(b, ["id", "path"], "full_outer").where(~F.col("ka").eqNullSafe(F.col("kb")))
    both = both.where(~(F.col("path").endswith("]") & (F.col("ka").isNull() | F.col("kb").isNull())))
    problem = F.when(F.col("ka").isNull() | F.col("kb").isNull(), "present on one side only").otherwise(F.concat(F.lit("shape differs: "), "ka", F.lit(" vs "), "kb"))
    rows = keep(both.select("id", "path", problem.alias("problem")))
    # A path under one that differs is not reported: its own prefixes are looked up. So are elements beyond the shorter array.
    cut = F.filter(F.sequence(F.lit(1), F.length("path") - 1), lambda i: F.substring(F.col("path"), i + 1, F.lit(1)).isin(".", "["))
    above = rows.select("id", "path", F.explode(F.transform(cut, lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("above"))
    sides = a.join(b, ["id", "path"], "full_outer").where(~F.col("ka").eqNullSafe(F.col("kb"))).select("id", F.col("path").alias("above"))
    under = above.join(sides.distinct(), ["id", "above"]).select("id", "path").distinct()
    return rows.join(under, ["id", "path"], "left_anti")
