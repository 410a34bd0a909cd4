"""Jobs on reading documents and on dossiers. Stand-ins: customers rendered as files in six shapes (set = nation), so that every
row shape occurs; dossiers and model output as JSON made of customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .catalog import _FILES, _HEADERS, _typed_sql, documents, job, read
from .operators import dossier, reading
from .plans.fact_pipeline import FactStore
from .sources import facts as sources
from .work import spread, work_folder, written

_ZONE = "concat('P<UTODOE<<JANE<QUINN<<<<<<<<<<<<<<<<\\nEQ', lpad(cast(c_custkey as string), 7, '0'), '0UTO0001010M30010100<<<<<<<<<<<00\\nThis letter is to certify that Jane Quinn, ID No: UGR/', c_custkey, '/00 is an active 4th Year')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(rf"""case c_custkey % 6
      when 0 then concat('Full Name: ', c_name, '\nNationality: ', c_mktsegment, '\nwrite to jane.quinn@example.com or www.example.com/jane')
      when 1 then concat('Full Name ', c_name, '   Place of Birth Town ', c_nationkey)
      when 2 then concat('Full Name\n', c_name, '\nDate of Birth 04/03/2001')
      when 3 then concat('Full Name ....... ', c_name, '\nDepartment | ', c_mktsegment, '\nand Design')
      when 4 then concat('Languages spoken include many things\nEmail address book of ', c_name, '\nnothing')
      else {_ZONE} end""")
    customers = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
    return customers.select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("file_name"), text.alias("text"))


LABELLED = """select c_nationkey as set_id, c_custkey as file, 'name' as field, c_name as value from customer where c_custkey % 6 < 4
  union all select c_nationkey, c_custkey, 'nationality', c_mktsegment from customer where c_custkey % 6 = 0
  union all select c_nationkey, c_custkey, 'place_of_birth', 'Town ' || c_nationkey from customer where c_custkey % 6 = 1
  union all select c_nationkey, c_custkey, 'dob', '2001-03-04' from customer where c_custkey % 6 = 2
  union all select c_nationkey, c_custkey, 'department', c_mktsegment || ' and Design' from customer where c_custkey % 6 = 3"""


@job("labelled_pairs", LABELLED)
def labelled_pairs(spark, sf_dir):
    return reading.labelled_pairs(files(spark, sf_dir)).select("set_id", F.col("source").alias("file"), "field", "value")


@job("all_candidates", f"""with c as ({LABELLED}), t as (
    select field, 4 as rule_rank, count(*) as n from c group by field
    union all select 'phone', 3, count(*) from customer where c_custkey % 6 < 5
    union all select 'email', 3, count(*) from customer where c_custkey % 6 = 0 union all select 'url', 3, count(*) from customer where c_custkey % 6 = 0
    union all select f, 3, count(*) from customer, (select unnest(['name', 'last_name', 'passport', 'nationality', 'dob', 'gender']) as f) where c_custkey % 6 = 5 group by f
    union all select f, 2, count(*) from customer, (select unnest(['name', 'id', 'year_standing']) as f) where c_custkey % 6 = 5 group by f
    union all select 'name', 1, count(*) from customer where c_custkey % 6 = 2)
  select field, cast(rule_rank as bigint) as rule_rank, cast(sum(n) as bigint) as n from t group by all""")
def all_candidates(spark, sf_dir):
    found = reading.all_candidates(files(spark, sf_dir))
    return found.groupBy("field", F.col("rule_rank").cast("long").alias("rule_rank")).agg(F.count("*").alias("n"))


@job("name_score", """with n as (select c_nationkey as set_id, count(*) filter (c_custkey % 6 = 5) as z, count(*) filter (c_custkey % 6 = 0) as h from customer group by 1)
  select set_id, 'Jane Quinn Doe' as value, cast(105 + 12 * least(z - 1, 3) + case when h > 0 then 50 else 0 end as bigint) as score, 'high' as confidence from n where z > 0
  union all select n.set_id, arg_min(c_name, c_custkey), 50, 'high' from n join customer on c_nationkey = n.set_id where z = 0 and c_custkey % 6 < 4 group by n.set_id""")
def name_score(spark, sf_dir):
    return reading.name_score(written(reading.all_candidates(files(spark, sf_dir)), "candidates"))


# Facts of documents and of the rendered files together: what each tier reads is listed, then agreement, scores and winners are computed.
_RENDERED = """(select 'nation ' || c_nationkey as set_id, c_custkey as file, case c_custkey % 6
    when 0 then 'Full Name: ' || c_name || chr(10) || 'write to jane.quinn@example.com or www.example.com/jane' when 5 then '' else c_name end as t from customer)"""
_CAND = f"""select set_id, file, field, value, 3 as r, 2 as tier, 0 as line from ({_typed_sql(_FILES)})
  union all select set_id, file, field, value, 3, 2, 0 from ({_typed_sql(_RENDERED)})
  union all select set_id, file, 'name', value, 1, 5, line from ({_HEADERS})
  union all select 'nation ' || set_id, file, field, value, 4, 1, 0 from ({LABELLED})
  union all select 'nation ' || c_nationkey, c_custkey, f[1], f[2], 3, 3, 0 from (select c_nationkey, c_custkey, unnest([['name', 'Jane Quinn Doe'], ['last_name', 'Doe'], ['passport', 'EQ' || lpad(c_custkey::varchar, 7, '0')], ['nationality', 'UTO'], ['dob', '2000-01-01'], ['gender', 'Male']]) as f from customer where c_custkey % 6 = 5)
  union all select 'nation ' || c_nationkey, c_custkey, f[1], f[2], 2, 4, 0 from (select c_nationkey, c_custkey, unnest([['name', 'Jane Quinn'], ['id', 'UGR/' || c_custkey || '/00'], ['year_standing', '4th Year']]) as f from customer where c_custkey % 6 = 5)
  union all select 'nation ' || c_nationkey, c_custkey, 'name', 'Full Name', 1, 5, 0 from customer where c_custkey % 6 = 2"""
_WORDS = r"""list_filter(string_split_regex(regexp_replace(strip_accents(lower({0})), '[^a-z\s]', '', 'g'), '\s+'), lambda x: length(x) > 2)"""
_ORG, _DOC = (x.replace("'", "''") for x in (reading.ORGANISATION, reading.DOCUMENT))

FACTS_SQL = rf"""with c as ({_CAND}),
  g as (select set_id, field, lower(trim(value)) as key, count(distinct file) as n, max(r) as r, first(trim(value) order by r desc, file, tier, line) as value, first(file order by r desc, file, tier, line) as source,
    first(lpad(file::varchar, 12, '0') || tier || line order by r desc, file, tier, line) as seq from c group by all),
  z as (select set_id, first(value order by file) as zone from c where field = 'name' and tier = 3 group by set_id),
  h as (select set_id, list_distinct(list(regexp_replace(lower(case field when 'email' then split_part(value, '@', 1) else value end), '[^a-z]', '', 'g'))) as handles from c where field in ('email', 'url') group by set_id),
  s as (select g.*, {_WORDS.format('value')} as words, {_WORDS.format("coalesce(zone, '')")} as zoned, zone, coalesce(handles, []) as handles from g left join z using (set_id) left join h using (set_id) where field = 'name'),
  t as (select *, len(list_intersect(words, zoned)) as same, len(list_filter(list_distinct(words), lambda w: len(list_filter(handles, lambda x: contains(x, w))) > 0)) as hits from s),
  p as (select *, case when len(words) = 0 then -100 else case r when 4 then 50 when 3 then 45 when 2 then 25 else 5 end + case when zone is null or same = 0 then 0 when same = 1 then 25 else 60 end
    + case when hits = 0 then 0 when hits = 1 then 20 else 50 end + 12 * least(n - 1, 3) - case when regexp_matches(value, '{_ORG}') then 70 else 0 end - case when regexp_matches(value, '{_DOC}') then 40 else 0 end end as score from t),
  o as (select *, row_number() over (partition by set_id, field order by r desc, n desc, seq) as k from g where field <> 'name')
  select set_id, field, lower(value) as value, source, n as corroboration, case when r >= 3 or (r = 2 and n > 1) then 'high' when r = 2 or n > 1 then 'medium' else 'low' end as confidence from o where k = 1 or field in ('email', 'url', 'phone', 'skills', 'language')
  union all select set_id, field, lower(value), source, n, case when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end from (select *, row_number() over (partition by set_id order by score desc, seq) as k from p) where k = 1"""


@job("fact_pipeline", f"""select * from ({FACTS_SQL}) where set_id <> 'src3' or field <> 'phone' union all select 'src3', 'phone', 'none', -1, 1, 'high'""")
def fact_pipeline(spark, sf_dir):
    """Facts of documents and rendered files after two runs, the first without some files, with the phone of one set put right by hand."""
    rendered = files(spark, sf_dir).select(F.concat(F.lit("nation "), F.col("set_id").cast("string")).alias("set_id"), "file_name", "text")
    docs = documents(spark, sf_dir).unionByName(rendered)
    store = FactStore(spark, work_folder(spark, "facts"), written)
    store.refresh(docs.where("set_id <> 'src2' and set_id <> 'nation 3' and (set_id <> 'src1' or file_name % 5 > 0)"), 1, "p")
    store.refresh(docs, 1, "p")
    manual = spark.range(1).select(F.lit("src3").alias("set_id"), F.lit("phone").alias("field"), F.lit("none").alias("value"), F.lit(-1).cast("long").alias("source"), F.lit(1).cast("long").alias("corroboration"), F.lit("high").alias("confidence"))
    return store.facts(manual).withColumn("value", F.lower("value"))


_TERMS = ", ".join(f"('{k}', '{w}')" for k, w in dict.fromkeys((f"{lang} {kind}", w) for lang, sets in rules.NAV_LABELS.items() for kind, at in (("submit", 2), ("next", 0), ("back", 1)) for w in sets[at] if " " not in w))


@job("rule_tables", rf"""with r as (select * from (values {_TERMS}) as v(key, term)), w as (select lower(unnest(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'))) as w from documents)
  select key, term, count(w) as n from r left join w on w = term group by all""")
def rule_tables(spark, sf_dir):
    """How often the one-word terms of a vocabulary occur in the documents: what it would cost to look them up."""
    terms = rules.rule_tables(spark).where("vocabulary = 'navigation'").where(~F.contains("term", F.lit(" "))).select("key", "term")
    words = documents(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n"))
    return terms.join(words, "term", "left").select("key", "term", F.coalesce("n", F.lit(0)).alias("n"))


@job("facts_sink", f"""select set_id, field, count(*) as n from ({LABELLED}) group by all""")
def facts_sink(spark, sf_dir):
    """Facts written by set, the first half twice, and read back."""
    path = work_folder(spark, "facts")
    rows = reading.labelled_pairs(files(spark, sf_dir)).select("set_id", "field", "value")
    sources.write_facts(rows, path)
    sources.write_facts(rows.where("set_id < 12"), path)
    return spark.read.schema("field string, value string, set_id int").parquet(path).groupBy(F.col("set_id").cast("long").alias("set_id"), "field").agg(F.count("*").alias("n"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""case when c_custkey % 3 = 0 then concat('[{"key":"segment","value":" ', c_mktsegment, ' ","source_filename":"cv.pdf"},{"key":"blank","value":"  "},{"value":"keyless"}]')
      when c_custkey % 3 = 1 then concat('{"segment":{"value":"', c_mktsegment, '","confidence":"high"},"name":{"value":"', c_name, '","source_filename":"a.txt","confidence":"medium"}}') else 'null' end""")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.lit("identity").alias("section"), body.alias("body"))


_LONG = """select c_custkey as set_id, 'identity' as section, 'segment' as key, c_mktsegment as value, case c_custkey % 3 when 0 then 'cv.pdf' else '(unattributed)' end as source_filename, case c_custkey % 3 when 0 then 'low' else 'high' end as confidence from customer where c_custkey % 3 < 2
  union all select c_custkey, 'identity', 'name', c_name, 'a.txt', 'medium' from customer where c_custkey % 3 = 1"""


@job("dossier_long", _LONG)
def dossier_long(spark, sf_dir):
    return dossier.dossier_long(_sections(spark, sf_dir))


@job("fact_counts", f"""with s as (select set_id, count(*) as scalar from ({_LONG}) group by set_id), n as (select o_custkey as set_id, sum(case when o_orderkey % 2 = 0 then 2 else 1 end) as nested from orders group by 1)
  select coalesce(s.set_id, n.set_id) as set_id, coalesce(scalar, 0) as scalar, cast(coalesce(nested, 0) as bigint) as nested, cast(coalesce(scalar, 0) + coalesce(nested, 0) as bigint) as facts from s full join n on s.set_id = n.set_id""")
def fact_counts(spark, sf_dir):
    one, two = F.create_map(F.lit("status"), F.col("o_orderstatus")), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    nested = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.when(F.col("o_orderkey") % 2 == 0, two).otherwise(one).alias("entry"))
    return dossier.fact_counts(dossier.dossier_long(_sections(spark, sf_dir)), nested)


@job("contract_issues", """with o as (select o_orderkey as id, o_orderkey % 6 as k from orders)
  select id, case k when 0 then 'answers' when 1 then 'answers[0].evidence' when 2 then 'answers[0].evidence[0].snippet' when 3 then 'answers[0].question_id' else 'answers[0]' end as path,
    case k when 0 then 'expected array, got missing' when 1 then 'expected array, got missing' when 2 then 'missing' when 3 then 'expected number, got string' else 'not an object' end as problem from o where k < 5
  union all select id, 'answers[1].value', 'expected string, got null' from o where k = 3""")
def contract_issues(spark, sf_dir):
    good = '{"question_id":1,"value":"x","evidence":[{"dossier_path":"p","source_filename":"f.pdf","snippet":"","implied_value":"v"}]}'
    bodies = [
        "not json", '[{"question_id":1,"value":"x"}]', '[{"question_id":1,"value":"x","evidence":[{"dossier_path":"p","source_filename":"f.pdf","implied_value":"v"}]}]',
        '[{"question_id":"1","value":"x","evidence":[]},{"question_id":2,"value":null,"evidence":[]}]', "[7]", f"[{good},{good}]",
    ]
    body = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.lit(b)) for i, b in enumerate(bodies)])
    return dossier.contract_issues(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("answers")))


@job("shape_diff", """with c as (select c_custkey as id, c_custkey % 4 as k from customer)
  select id, case k when 1 then '#.b' when 2 then '#.a[0].x' else '#.a' end as path, case k when 1 then 'present on one side only' when 2 then 'shape differs: number vs string' else 'shape differs: array vs object' end as problem from c where k > 0""")
def shape_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    other = F.coalesce(*[F.when(F.col("c_custkey") % 4 == i, F.lit(b)) for i, b in enumerate(['{"a":[{"x":2},{"x":3}],"b":{"c":"z"}}', '{"a":[]}', '{"a":[{"x":"1"}],"b":{"c":"q"}}', '{"a":{"y":1},"b":{"c":""}}'])])
    mine = c.select(F.col("c_custkey").alias("id"), F.lit('{"a":[{"x":1}],"b":{"c":"d"}}').alias("body"))
    return dossier.shape_diff(mine, c.select(F.col("c_custkey").alias("id"), other.alias("body")), lambda df: written(df, "shapes"))
