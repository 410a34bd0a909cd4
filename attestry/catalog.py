"""All jobs of the library by name, bound to the tables of one folder, with SQL that says the same.

Stand-ins: a document set is a `source`, its files are `doc_id`; `events` is the request log (key = user_id,
errors carry observed limits in `value`, purchases the user's own); drafts are turns of `conversations`.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import audits, corpus, facts, forms, ledgers, pages, questions, reading, similarity
from .plans import fact_pipeline as plans
from .sources import facts as sources
from .streaming import grouped
from .streaming import in_order as ordered
from .streaming import ledger as streams
from .work import work_folder, written

Query = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, tuple[Query, str | None]] = {}


def job(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        JOBS[name] = f, sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("set_id"), F.col("doc_id").alias("file_name"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", "event_type", "value")


# Documents


@job("load_corpus", r"""select source as set_id, doc_id as file_name, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as text,
  cast(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) as bigint) as n_chars, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' as empty from documents""")
def load_corpus(spark, sf_dir):
    return corpus.load_corpus(documents(spark, sf_dir))


NOTES = r"""select source as set_id, doc_id as file_name, cast(length(coalesce(text, '')) as bigint) as n_chars,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\p{L}\p{N}\s.,:/@+()''’-]')) as bigint) as n_odd from documents"""
NOTED = f"""select *, case when n_chars = 0 then 'no text' when n_chars < 200 then 'short' when n_odd / n_chars > 0.08 then 'noisy' else 'clean' end as note from ({NOTES})"""


@job("read_quality", f"""select set_id, count(*) as n_files, cast(sum(n_chars) as bigint) as chars, cast(sum(n_odd) as bigint) as odd,
  count(*) filter (note = 'no text') as n_no_text, count(*) filter (note = 'short') as n_short, count(*) filter (note = 'noisy') as n_noisy,
  count(*) filter (note = 'clean') as n_clean from ({NOTED}) group by set_id""")
def read_quality(spark, sf_dir):
    return corpus.read_quality(documents(spark, sf_dir))


def _typed_sql(files: str) -> str:
    """What reading.typed finds in files (set_id, file, t), t not null: (set_id, file, field, value), distinct."""
    return rf"""select set_id, file, 'email' as field, unnest(list_distinct(regexp_extract_all(tight, '{tx.EMAIL}'))) as value from ({_zone_free(files)})
  union all select set_id, file, 'url', unnest(list_filter(list_distinct(regexp_extract_all(tight, '{tx.URL.replace("'", "''")}')), lambda u: not contains(u, '@'))) from ({_zone_free(files)})
  union all select * from (select distinct set_id, file, 'phone' as field, regexp_replace(trim(unnest(regexp_extract_all(whole, '{tx.PHONE}'))), '\s{{2,}}', ' ', 'g') as value from ({_zone_free(files)}))
    where length(regexp_replace(value, '[^0-9]', '', 'g')) between 7 and 15"""


def _zone_free(files: str) -> str:
    return rf"""select *, regexp_replace(whole, '\s*([@.])\s*', '\1', 'g') as tight from (select set_id, file, array_to_string(list_filter(string_split_regex(t, '\r?\n'),
    lambda x: not regexp_matches(regexp_replace(x, '\s+', '', 'g'), '^[A-Z0-9<]{{20,}}$')), chr(10)) as whole from {files})"""


_FILES = "(select source as set_id, doc_id as file, coalesce(text, '') as t from documents)"
_HEADERS = rf"""select set_id, file, line, value from (select set_id, file, unnest(range(0, len(ls))) as line, unnest(ls) as value from (select set_id, file,
    list_slice(list_filter(list_transform(string_split_regex(whole, '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), 1, 8) as ls from ({_zone_free(_FILES)})))
  where length(value) <= 60 and not regexp_matches(value, '[@0-9]') and regexp_matches(value, '{reading.NAME_SHAPE.replace("'", "''")}')"""


@job("extraction_report", rf"""with c as (select set_id, file, field, lower(trim(value)) as v, 3 as r from ({_typed_sql(_FILES)}) union all select set_id, file, 'name', lower(trim(value)), 1 from ({_HEADERS})),
  g as (select file, count(distinct (field, v)) as n_facts, count(distinct (field, v)) filter (r = 3) as typed, count(distinct (field, v)) filter (r = 1) as "positional", array_to_string(list_sort(list_distinct(list(field))), ',') as fields from c group by file)
  select n.set_id, n.file_name, n_chars, note, coalesce(n_facts, 0) as n_facts, cast(0 as bigint) as labelled, coalesce(typed, 0) as typed, cast(0 as bigint) as contextual, coalesce(g."positional", 0) as "positional", coalesce(fields, '') as fields
  from ({NOTED}) n left join g on g.file = n.file_name""")
def extraction_report(spark, sf_dir):
    """The report over documents, whose texts hold no labelled rows and none of the sentences; written as JSON and read back."""
    docs = documents(spark, sf_dir)
    report = corpus.extraction_report(docs, reading.all_candidates(docs))
    path = work_folder(spark, "report")
    sources.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_TALLY = ", ".join(f"sum(len(regexp_extract_all(coalesce(text, ''), '{p}'))) as \"{c}\"" for c, p in tx.SCRIPTS)
_NAMES = ", ".join(f'"{c}"' for c, _ in tx.SCRIPTS)
_CASE = " ".join(f"when \"{c}\" = greatest({_NAMES}) then '{c}'" for c, _ in tx.SCRIPTS)


@job("language_by_script", f"""select set_id, cast(n as bigint) as n_letters, language, coalesce(language in ('ar', 'he'), false) as rtl from
  (select set_id, n, case when n >= 3 then case {_CASE} end end as language from (select *, {' + '.join(f'"{c}"' for c, _ in tx.SCRIPTS)} as n from (select source as set_id, {_TALLY} from documents group by source)))""")
def language_by_script(spark, sf_dir):
    return corpus.language_by_script(documents(spark, sf_dir))


@job("set_fingerprint", """select set_id, count(*) as n_files, sha256(string_agg(e, '|' order by e)) as fingerprint from
  (select source as set_id, sha256(cast(doc_id as varchar) || '#' || length(coalesce(text, '')) || ':' || sha256(coalesce(text, ''))) as e from documents) group by set_id""")
def set_fingerprint(spark, sf_dir):
    return corpus.digest_fingerprint(documents(spark, sf_dir))


@job("change_verdict", """with c as (select source as set_id, string_agg(sha256(coalesce(text, '')), '' order by doc_id) as f from documents where doc_id % 7 <> 3 or source <> 'src1' group by source),
  o as (select source as set_id, string_agg(sha256(coalesce(text, '')), '' order by doc_id) as f from documents where source <> 'src2' group by source)
  select coalesce(c.set_id, o.set_id) as set_id, case when o.set_id is null then 'nothing cached' when c.set_id is null then 'removed' when o.set_id = 'src4' then 'unknown provider' when o.set_id = 'src5' then 'provider' when o.set_id = 'src6' then 'model'
    when o.f <> c.f then 'files changed' when coalesce(c.set_id, o.set_id) = 'src3' then 'version' else 'reuse' end as verdict from c full join o on c.set_id = o.set_id""")
def change_verdict(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mark = lambda d, v, p, m: corpus.set_fingerprint(d).select("set_id", "fingerprint", v.alias("version"), p.alias("provider"), m.alias("model"))
    now = mark(docs.where((F.col("file_name") % 7 != 3) | (F.col("set_id") != "src1")), F.lit(2), F.lit("p"), F.lit("m"))
    of = lambda s, x, y: F.when(F.col("set_id") == s, F.lit(x)).otherwise(F.lit(y))
    old = mark(docs.where("set_id <> 'src2'"), of("src3", 1, 2), F.when(F.col("set_id") == "src5", "q").when(F.col("set_id") != "src4", "p"), of("src6", "n", "m"))
    return corpus.change_verdict(now, old)


@job("dedupe_keep_first", """select doc_id, f as duplicate_of from (select doc_id, min(doc_id) over (partition by text) as f from documents where text is not null) where doc_id <> f""")
def dedupe_keep_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, removed = corpus.dedupe_keep_first(docs, F.sha2("text", 256), "doc_id")
    return removed.select("doc_id", "duplicate_of")


@job("coverage_report", """select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as total, cast(grouping(source, lang) as bigint) as level
  from documents group by grouping sets ((source, lang), (source), ())""")
def coverage_report(spark, sf_dir):
    return corpus.coverage_report(read(spark, sf_dir, "documents"), "source", "lang", "n_chars")


@job("header_names", r"""select set_id, file_name, line_no, value from (select set_id, file_name, unnest(range(0, len(ls))) as line_no, unnest(ls) as value from
  (select source as set_id, doc_id as file_name, list_slice(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 8) as ls from documents))
  where length(value) <= 60 and regexp_matches(value, '^[A-ZÀ-Þ][A-Za-zÀ-ÿ''.-]*( [A-ZÀ-Þ][A-Za-zÀ-ÿ''.-]*){1,3}$')""")
def header_names(spark, sf_dir):
    return corpus.header_names(documents(spark, sf_dir))


@job("payload_budget", """with s as (select source as set_id, doc_id, strlen(coalesce(text, '')) as b, row_number() over (partition by source order by strlen(coalesce(text, '')) desc, cast(doc_id as varchar)) as r from documents)
  select set_id, cast(sum(b) as bigint) as bytes, cast(ceil(sum(b) * 4 / 3) as bigint) as encoded, cast(greatest(ceil(sum(b) * 4 / 3) - 100000, 0) as bigint) as over,
    string_agg(cast(doc_id as varchar), ',' order by r) filter (r <= 5) as largest from s group by set_id""")
def payload_budget(spark, sf_dir):
    return corpus.payload_budget(documents(spark, sf_dir), ceiling=100_000)


@job("batches", """select doc_id, source, cast((row_number() over (partition by source order by doc_id) - 1) // 12 as bigint) as batch_no from documents""")
def batches(spark, sf_dir):
    return corpus.batches(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@job("grounding_check", r"""with c as (select item_id as claim_id, source as set_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as v from benchmark, (select distinct source from documents where source in ('src1', 'src2'))),
  t as (select distinct claim_id, set_id, unnest(string_split(v, ' ')) as token from c),
  h as (select distinct source as set_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) as token from documents)
  select claim_id * 10 + case set_id when 'src1' then 1 else 2 end as claim_id, count(*) filter (length(t.token) > 2 and h.token is null) = 0 as grounded,
    cast(count(*) filter (length(t.token) > 2 and h.token is null) as bigint) as n_missing from t left join h using (set_id, token) group by claim_id, set_id""")
def grounding_check(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").withColumn("set_id", F.explode(F.array(F.lit("src1"), F.lit("src2"))))
    claims = items.select((F.col("item_id") * 10 + F.substring("set_id", 4, 1).cast("int")).alias("claim_id"), "set_id", F.col("text").alias("value"))
    return corpus.grounding_check(claims, documents(spark, sf_dir))


@job("grounded_values", r"""with b as (select item_id * 10 + k as claim_id, 'src' || (1 + item_id % 2) as set_id, case k when 0 then text when 1 then string_split(text, ' ')[1] || ' and ' || string_split(text, ' ')[2] when 2 then '55-' || item_id || ' 000-1' else ' ' end as value from benchmark, (select unnest([0, 1, 2, 3]) as k)),
  c as (select *, trim(regexp_replace(lower(value), '[^\p{L}\p{N}]+', ' ', 'g')) as v, regexp_replace(value, '[^0-9]', '', 'g') as d from b),
  d as (select source as set_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) as t, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') as td from documents),
  w as (select distinct claim_id from c join d using (set_id) where v <> '' and t <> '' and (contains(t, v) or (length(d) >= 5 and contains(td, d)))),
  k as (select claim_id, set_id, token from (select claim_id, set_id, unnest(string_split(v, ' ')) as token from c where v <> '') where length(token) > 2 and token not in ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'was', 'are', 'not', 'yes', 'no', 'n/a', 'na', 'none')),
  a as (select distinct claim_id from k where not exists (select 1 from d where d.set_id = k.set_id and contains(t, token)))
  select claim_id, v <> '' and (claim_id in (select claim_id from w) or claim_id not in (select claim_id from a)) and set_id in (select set_id from d where t <> '') as grounded from c""")
def grounded_values(spark, sf_dir):
    words = F.split("text", " ")
    claims = F.array(F.col("text"), F.concat(words[0], F.lit(" and "), words[1]), F.concat(F.lit("55-"), F.col("item_id").cast("string"), F.lit(" 000-1")), F.lit(" "))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(claims).alias("k", "value"))
    items = items.select((F.col("item_id") * 10 + F.col("k")).alias("claim_id"), F.concat(F.lit("src"), (F.col("item_id") % 2 + 1).cast("string")).alias("set_id"), "value")
    return corpus.grounded_values(items, documents(spark, sf_dir)).select("claim_id", "grounded")


# Facts

@job("distinct_typed", _typed_sql(_FILES))
def distinct_typed(spark, sf_dir):
    return reading.typed(documents(spark, sf_dir)).select("set_id", F.col("source").alias("file"), "field", "value")


_READ = f"""(select set_id, file, field, value, 3 as r from ({_typed_sql(_FILES)}) union all select set_id, file, 'name', value, 1 from ({_HEADERS}))"""
_AGREED = f"""select set_id, field, lower(trim(value)) as key, count(distinct file) as corroboration, max(r) as r, min(file) as seq from {_READ} group by all"""


@job("corroborate", f"""select set_id, field, key, corroboration from ({_AGREED})""")
def corroborate(spark, sf_dir):
    return facts.corroborate(reading.all_candidates(documents(spark, sf_dir))).select("set_id", "field", "key", "corroboration")


@job("reconcile_facts", f"""select set_id, field, key as value, corroboration, case when r >= 3 then 'high' when corroboration > 1 then 'medium' else 'low' end as confidence
  from (select *, row_number() over (partition by set_id, field order by r desc, corroboration desc, seq) as n from ({_AGREED})) where n = 1 or field <> 'name'""")
def reconcile_facts(spark, sf_dir):
    """All candidates of the documents: the values of several-valued fields, and the header line that most files agree on."""
    found = facts.reconcile_facts(reading.all_candidates(documents(spark, sf_dir)))
    return found.select("set_id", "field", F.lower("value").alias("value"), "corroboration", "confidence")


@job("manual_override", """select c_custkey as set_id, 'segment' as field, c_mktsegment as value, 'manual' as origin from customer where c_acctbal > 5000
  union all select c_custkey, 'segment', 'derived', 'derived' from customer where c_acctbal <= 5000 union all select c_custkey, 'name', c_name, 'derived' from customer""")
def manual_override(spark, sf_dir):
    people = read(spark, sf_dir, "customer")
    row = lambda d, f, v, o: d.select(F.col("c_custkey").alias("set_id"), F.lit(f).alias("field"), v.alias("value"), F.lit(o).alias("origin"))
    derived = row(people, "segment", F.lit("derived"), "derived").unionByName(row(people, "name", F.col("c_name"), "derived"))
    return facts.manual_override(derived, row(people.where("c_acctbal > 5000"), "segment", F.col("c_mktsegment"), "manual"))


@job("plausibility_gate", rf"""select field, cast(count(*) filter (ok) as bigint) as accepted, cast(count(*) filter (not ok) as bigint) as rejected from (select field,
  case when field = 'email' then regexp_matches(value, '^[^\s@]+@[^\s@]+\.[^\s@]{{2,}}$') when field = 'phone' then length(regexp_replace(value, '[^0-9]', '', 'g')) between 7 and 15
    when field = 'id' then regexp_matches(value, '[0-9]') and length(value) <= 40 else regexp_matches(value, '^[A-Za-z0-9][A-Za-z0-9 -]{{1,11}}$') end as ok from (
  select 'email' as field, trim(unnest(string_split(coalesce(text, ''), ' '))) as value from documents union all select 'phone', trim(unnest(string_split(coalesce(text, ''), ' '))) from documents
  union all select 'id', c_name from customer union all select 'postal_code', p_brand from part) where value <> '') group by field""")
def plausibility_gate(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("value")).where(F.trim("value") != "")
    row = lambda d, f: d.select(F.lit(f).alias("field"), F.trim("value").alias("value"))
    ids = read(spark, sf_dir, "customer").select(F.col("c_name").alias("value"))
    codes = read(spark, sf_dir, "part").select(F.col("p_brand").alias("value"))
    return facts.plausibility_gate(row(words, "email").unionByName(row(words, "phone")).unionByName(row(ids, "id")).unionByName(row(codes, "postal_code")))


@job("dossier_reconcile", r"""with f as (select n_nationkey as key, n_name as value, 3 + n_nationkey % 2 as r from nation),
  d as (select n_nationkey as key, case n_nationkey % 4 when 0 then lower(n_name) when 1 then n_name || ' region' when 2 then 'other' end as o, case when n_nationkey % 3 = 0 then 'high' else 'low' end as c from nation where n_nationkey % 5 <> 4),
  j as (select f.key, value, r, o, c, regexp_replace(lower(value), '[^a-z0-9@+]', '', 'g') as a, regexp_replace(lower(o), '[^a-z0-9@+]', '', 'g') as b from f left join d on f.key = d.key),
  v as (select *, case when o is null then 'only fact' when a = b then 'agree' when contains(a, b) or contains(b, a) then 'contained' when r >= 4 and c <> 'high' then 'fact wins' else 'conflict' end as verdict from j)
  select key, verdict, case when verdict = 'contained' then case when length(o) > length(value) then o else value end when verdict <> 'conflict' then value end as resolved from v""")
def dossier_reconcile(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("key", F.col("n_nationkey"))
    mine = n.select("key", F.col("n_name").alias("value"), (F.lit(3) + F.col("key") % 2).alias("rule_rank"))
    k = F.col("key") % 4
    told = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat("n_name", F.lit(" region"))).when(k == 2, F.lit("other"))
    other = n.where("key % 5 <> 4").select("key", told.alias("value"), F.when(F.col("key") % 3 == 0, "high").otherwise("low").alias("confidence"))
    return facts.dossier_reconcile(mine, other)


_DATES = r"""select o_custkey % 10 as set_id, o_orderkey as id, case o_custkey % 3 when 0 then 'DMY' when 1 then 'MDY' end as hint, case hash_form
    when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%-m/%-d') when 2 then strftime(o_orderdate, '%-d.%-m.%Y') when 3 then strftime(o_orderdate, '%-d-%-m-%Y') when 4 then strftime(o_orderdate, '%-m/%-d/%Y')
    when 5 then strftime(o_orderdate, '%-d %B %Y') when 6 then strftime(o_orderdate, '%b %-d, %Y') when 7 then strftime(o_orderdate, '%-d%b%Y') when 8 then strftime(o_orderdate, '%Y-02-%d') when 9 then strftime(o_orderdate, '%d/%d/%Y')
    when 10 then strftime(o_orderdate, '%B %Y') when 11 then 'Marble 3, 2001' when 12 then ' ' when 13 then null else 'due ' || strftime(o_orderdate, '%Y-%m-%d') end as raw
  from (select *, (o_orderkey * 7 + o_custkey) % 15 as hash_form from orders)"""


@job("date_audit", rf"""with d as (select *, trim(coalesce(raw, '')) as v from ({_DATES})),
  m as (select *, regexp_extract(v, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})$', ['y', 'm', 'd']) as i, regexp_extract(v, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})$', ['a', 'b', 'y']) as n,
    regexp_extract(v, '^(\d{{1,2}})?\s*([A-Za-z]{{3,}})\.?,?\s*(\d{{1,2}})?,?\s*(\d{{4}})$', ['d', 'm', 'e', 'y']) as w from d),
  k as (select *, case when i.y <> '' then [i.y, i.m, i.d] when n.y <> '' then case when try_cast(n.a as int) > 12 and try_cast(n.b as int) > 12 then ['impossible'] when try_cast(n.a as int) > 12 or (try_cast(n.b as int) <= 12 and hint = 'DMY') then [n.y, n.b, n.a]
      when try_cast(n.b as int) > 12 or hint = 'MDY' then [n.y, n.a, n.b] else ['ambiguous'] end
    when w.y <> '' and len(list_filter({[m for m in "january february march april may june july august september october november december".split()]}, lambda x: starts_with(x, lower(w.m)))) > 0
      then [w.y, cast(list_position({[m[:3] for m in "january february march april may june july august september october november december".split()]}, lower(w.m[1:3])) as varchar), coalesce(nullif(w.d, ''), nullif(w.e, ''), '0')]
    when v = '' then ['blank'] else ['unknown format'] end as p from m),
  r as (select set_id, id, case when len(p) = 3 then strftime(try_cast(lpad(p[1], 4, '0') || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') as date), '%Y-%m-%d') end as day, case when len(p) = 1 then p[1] else 'impossible' end as why from k)
  select cast(set_id as varchar) as set_id, case when day is null then why else 'accepted' end as outcome, count(*) as n, coalesce(sha256(string_agg(day, ',' order by id)), sha256('')) as days from r group by all""")
def date_audit(spark, sf_dir):
    """Order dates printed in fifteen ways, some of them no dates, with a stated order for two thirds."""
    form, d = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 15, F.col("o_orderdate")
    say = ["yyyy-MM-dd", "yyyy/M/d", "d.M.yyyy", "d-M-yyyy", "M/d/yyyy", "d MMMM yyyy", "MMM d, yyyy", "dMMMyyyy", "yyyy-'02'-dd", "dd/dd/yyyy", "MMMM yyyy"]
    said = [F.concat(F.date_format(d, "dd"), F.lit("/"), F.date_format(d, "dd/yyyy")) if p == "dd/dd/yyyy" else F.date_format(d, p) for p in say]
    said += [F.lit("Marble 3, 2001"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit("due "), F.date_format(d, "yyyy-MM-dd"))]
    raw = F.coalesce(*[F.when(form == i, x) for i, x in enumerate(said)])
    hint = F.when(F.col("o_custkey") % 3 == 0, "DMY").when(F.col("o_custkey") % 3 == 1, "MDY")
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).cast("string").alias("set_id"), raw.alias("raw"), hint.alias("order_hint"), F.col("o_orderkey").alias("id"))
    found = rows.select("set_id", "id", facts.known_date(F.col("raw"), F.col("order_hint")).alias("r"))
    days = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r.date").isNotNull(), F.struct("id", "r.date")))), lambda x: x["date"]), ",")
    return found.groupBy("set_id", F.coalesce("r.reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.sha2(days, 256).alias("days"))


@job("time_audit", r"""with t as (select o_custkey % 10 as set_id, case o_orderkey % 5 when 0 then 'at ' || (o_custkey % 26) || ':' || lpad((o_orderkey % 61)::varchar, 2, '0') when 1 then (o_custkey % 13) || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || ' PM'
      when 2 then (o_custkey % 13) || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || 'am sharp' when 3 then 'noon' end as raw from orders),
  p as (select set_id, regexp_extract(lower(raw), '([0-9]{1,2}):([0-9]{2})\s*(am|pm)?', ['h', 'm', 'x']) as g from t),
  h as (select set_id, g.m as m, case when g.h = '' then null when g.x = 'pm' and try_cast(g.h as int) < 12 then try_cast(g.h as int) + 12 when g.x = 'am' and try_cast(g.h as int) = 12 then 0 else try_cast(g.h as int) end as h from p)
  select cast(set_id as varchar) as set_id, case when h <= 23 and try_cast(m as int) <= 59 then lpad(h::varchar, 2, '0') || ':' || m end as time, count(*) as n from h group by all""")
def time_audit(spark, sf_dir):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    half = F.concat((c % 13).cast("string"), F.lit(":"), two(o % 60))
    raw = F.when(o % 5 == 0, F.concat(F.lit("at "), (c % 26).cast("string"), F.lit(":"), two(o % 61))).when(o % 5 == 1, F.concat(half, F.lit(" PM"))).when(o % 5 == 2, F.concat(half, F.lit("am sharp"))).when(o % 5 == 3, "noon")
    rows = read(spark, sf_dir, "orders").select((c % 10).cast("string").alias("set_id"), raw.alias("raw"))
    return facts.time_audit(rows).groupBy("set_id", "time").agg(F.count("*").alias("n"))


# Ledgers

DAY = "cast(cast(ts at time zone 'UTC' at time zone 'America/Los_Angeles' as date) as varchar)"


@job("quota_ledger", f"""select user_id as key, {DAY} as day, count(*) as used, max(case when event_type = 'error' then cast(floor(value) as bigint) end) as limit,
  cast(greatest(max(case when event_type = 'error' then cast(floor(value) as bigint) end) - count(*), 0) as bigint) as remaining from events group by all""".replace("as limit,", 'as "limit",').replace(
    "cast(greatest(max(", "case when max(case when event_type = 'error' then 1 end) is not null then cast(greatest(max(").replace("0) as bigint) as remaining", "0) as bigint) end as remaining"))
def quota_ledger(spark, sf_dir):
    limit = F.when(F.col("event_type") == "error", F.floor("value"))
    ledger = ledgers.quota_ledger(events(spark, sf_dir).select("key", "ts", limit.alias("limit")))
    return ledger.withColumn("day", F.col("day").cast("string"))


@job("limit_carry_forward", f"""with d as (select user_id as key, {DAY} as day, count(*) as used, max(case when event_type = 'purchase' and value > 40 then cast(floor(value) as bigint) end) as u,
    max(case when event_type = 'error' then cast(floor(value) as bigint) end) as o from events group by all),
  c as (select key, day, used, last_value(u ignore nulls) over w as u, last_value(o ignore nulls) over w as o from d window w as (partition by key order by day rows unbounded preceding))
  select key, day, used, coalesce(u, o) as "limit", case when u is not null then 'user' when o is not null then 'observed' else 'unknown' end as limit_source from c""")
def limit_carry_forward(spark, sf_dir):
    e = events(spark, sf_dir)
    daily = e.groupBy("key", ledgers.pacific_day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("used"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 40), F.floor("value"))).alias("user_limit"),
        F.max(F.when(F.col("event_type") == "error", F.floor("value"))).alias("observed_limit"),
    )
    return ledgers.limit_carry_forward(daily).withColumn("day", F.col("day").cast("string"))


@job("rolling_rate", """with m as (select event_id, event_type as key, (epoch_us(ts) // 1000) as ms from events),
  w as (select *, count(*) over x as n, min(ms) over x as o from m window x as (partition by key order by ms range between 3600000 preceding and current row))
  select event_id, key, n as in_window, n > 2 as over, case when n > 2 then greatest(250, o + 3600000 - ms + 50) else 0 end as wait_ms from w""")
def rolling_rate(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", F.col("event_type").alias("key"), "ts")
    return ledgers.rolling_rate(log, rpm=4, window_ms=3_600_000)


@job("spacing_gaps", """with g as (select user_id as key, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as gap from events)
  select key, count(*) as n, min(gap) as least_gap_ms, cast(count(*) filter (gap < 5400000) as bigint) as violations from g group by key""")
def spacing_gaps(spark, sf_dir):
    return ledgers.spacing_gaps(events(spark, sf_dir), rpm=0.01)


@job("pacing_basis", """with l as (select event_id, user_id as key, last_value(case when event_type = 'error' then cast(floor(value) as bigint) end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as r from events)
  select event_id, key, coalesce(r, 5) as rpm, case when r is null then 'fallback' else 'learned' end as basis from l""")
def pacing_basis(spark, sf_dir):
    header = F.when(F.col("event_type") == "error", F.floor("value"))
    return ledgers.pacing_basis(events(spark, sf_dir).withColumn("rate_header", header))


@job("ttl_split", """select event_id as key, u as expires_at, u > timestamp '2024-01-15 00:00:00' as live from (select event_id,
  case when event_type = 'view' then date_trunc('second', ts) + interval 5 days else ts + interval 48 hours end - interval 1 hour as u from events)""")
def ttl_split(spark, sf_dir):
    e = events(spark, sf_dir)
    given = F.when(F.col("event_type") == "view", F.date_format(F.col("ts") + F.expr("interval 5 days"), "yyyy-MM-dd HH:mm:ss")).when(F.col("event_type") == "click", "soon")
    entries = e.select(F.col("event_id").alias("key"), F.col("ts").alias("uploaded_at"), given.alias("server_expiry"))
    return ledgers.ttl_split(entries, "2024-01-15 00:00:00").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@job("retention_purge", """select user_id as key, max(ts) as last_used from events where event_type = 'signup' group by user_id having max(ts) < timestamp '2024-01-31 00:00:00' - interval 3 days""")
def retention_purge(spark, sf_dir):
    old = ledgers.retention_purge(events(spark, sf_dir).where("event_type = 'signup'"), "2024-01-31 00:00:00", days=3)
    return old.withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


_VERSIONS = """with k as (select event_id, user_id as key, ts, case event_type when 'signup' then 'navigate' when 'view' then 'scan' when 'error' then 'remove' else 'answer' end as kind from events),
  p as (select *, count(*) filter (kind = 'remove') over (partition by key order by ts, event_id rows between unbounded preceding and 1 preceding) as part from k),
  l as (select *, epoch_ms(ts) - lag(epoch_ms(ts)) over w > 3 * 86400000 and count(*) filter (kind in ('navigate', 'scan')) over (w rows between unbounded preceding and 1 preceding) > 0 as late from p window w as (partition by key, part order by ts, event_id)),
  f as (select *, sum(case when late then 1 else 0 end) over (partition by key, part order by ts, event_id rows unbounded preceding) as life from l),
  g as (select *, count(*) filter (kind = 'navigate') over w as generation, count(*) filter (kind in ('navigate', 'scan')) over w as known from f window w as (partition by key, part, life order by ts, event_id rows unbounded preceding)),
  s as (select *, last_value(case when kind = 'scan' then generation end ignore nulls) over (partition by key, part, life order by ts, event_id rows unbounded preceding) as s from g)
  select event_id, key, case when known > 0 then generation end as generation, case when known = 0 then 'gone' when s is null then 'not scanned' when s < generation then 'navigated' else 'current' end as verdict from s where kind = 'answer'"""
IDLE_MS = 3 * 86_400_000


@job("version_check", _VERSIONS)
def version_check(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "signup", "navigate").when(t == "view", "scan").when(t == "error", "remove").otherwise("answer")
    return ledgers.version_check(events(spark, sf_dir).withColumn("kind", kind), IDLE_MS)


@job("job_snapshot", """with l as (select user_id % 7 as run_id, user_id as job, ts, event_id, case event_type when 'view' then 'queued' when 'click' then 'running' else event_type end as state from events),
  s as (select run_id, job, arg_max(state, ts) as state, max(ts) as ts from l group by all)
  select run_id, job, state, case when state = 'queued' then row_number() over (partition by run_id, state order by ts) end as position from s""")
def job_snapshot(spark, sf_dir):
    t = F.col("event_type")
    log = events(spark, sf_dir).select("event_id", (F.col("key") % 7).alias("run_id"), F.col("key").alias("job"), "ts", F.when(t == "view", "queued").when(t == "click", "running").otherwise(t).alias("state"))
    return ledgers.job_snapshot(log)


_RUN_LOG = """select event_id, user_id % 50 as form_id, user_id % 50 + 1000 * (day(ts) // 3 + case when event_id % 17 = 0 then -1 else 0 end) as run_id, user_id as job, ts,
  case event_type when 'signup' then 'start' when 'view' then 'queued' when 'click' then 'running' when 'error' then 'cancelled' else 'result' end as kind from {0}"""


@job("job_results", f"""with l as ({_RUN_LOG.format("events")}),
  w as (select *, last_value(case when kind = 'start' then run_id end ignore nulls) over (partition by form_id order by ts, event_id rows between unbounded preceding and 1 preceding) as live,
    last_value(case when kind <> 'start' then kind end ignore nulls) over (partition by form_id, run_id, job order by ts, event_id rows between unbounded preceding and 1 preceding) as state from l)
  select event_id, form_id, run_id, job, case when live is null then 'no run' when live <> run_id then 'superseded' when coalesce(state, '') <> 'running' then 'not running' else 'delivered' end as outcome from w where kind = 'result'""")
def job_results(spark, sf_dir):
    """Events as the log of forms' runs, a new run every three days."""
    e = events(spark, sf_dir)
    day = F.floor(F.dayofmonth("ts") / 3) + F.when(F.col("event_id") % 17 == 0, -1).otherwise(0)
    t = F.col("event_type")
    kind = F.when(t == "signup", "start").when(t == "view", "queued").when(t == "click", "running").when(t == "error", "cancelled").otherwise("result")
    form = F.col("key") % 50
    return ledgers.job_results(e.select("event_id", form.alias("form_id"), (form + 1000 * day).alias("run_id"), F.col("key").alias("job"), "ts", kind.alias("kind")))


@job("error_rollup", """with r as (select user_id % 3 as provider, case event_type when 'error' then 429 when 'view' then 500 when 'click' then 401 when 'signup' then 404 else 200 end as s, cast(floor(value) as bigint) as m from events)
  select provider, case s when 429 then 'rate limit' when 500 then 'server' when 401 then 'auth' when 404 then 'not found' else 'ok' end as kind, count(*) as n, max(s in (429, 500)) as retryable, max(m) as longest_retry_ms from r group by provider, s""")
def error_rollup(spark, sf_dir):
    t = F.col("event_type")
    status = F.when(t == "error", 429).when(t == "view", 500).when(t == "click", 401).when(t == "signup", 404).otherwise(200)
    return ledgers.error_rollup(events(spark, sf_dir).select((F.col("key") % 3).alias("provider"), status.alias("status"), F.floor("value").alias("retry_ms")))


@job("preflight", """with w as (select source as set_id, count(*) as q, source in ('src1', 'src2') as c from documents group by source),
  l as (select 'src' || (user_id % 18) as set_id, 40 - count(*) % 37 as r from events group by user_id % 18)
  select w.set_id, cast(case when c then 0 else 1 end + ceil(q / 12) as bigint) as requests, case when r is null then 'unknown limit' when case when c then 0 else 1 end + ceil(q / 12) > r then 'exceeds'
    when (case when c then 0 else 1 end + ceil(q / 12)) * 5 > r * 4 then 'tight' else 'ok' end as verdict,
    cast(case when r is null then q else least(q, greatest(r - case when c then 0 else 1 end, 0) * 12) end as bigint) as answerable from w left join l on w.set_id = l.set_id""")
def preflight(spark, sf_dir):
    work = documents(spark, sf_dir).groupBy("set_id").agg(F.count("*").alias("questions")).withColumn("cached", F.col("set_id").isin("src1", "src2"))
    left = events(spark, sf_dir).groupBy((F.col("key") % 18).alias("k")).agg(F.count("*").alias("n"))
    return ledgers.preflight(work, left.select(F.concat(F.lit("src"), F.col("k").cast("string")).alias("set_id"), (40 - F.col("n") % 37).alias("remaining")))


# Audits


@job("leak_guard", r"""select role, count(*) as n, cast(count(*) filter (regexp_matches(coalesce(text, ''), '(?i)\b(as an ai|as a language model|i cannot|i can''t|i''m unable to|i am unable to|i don''t have access|i do not have access|please provide|write something|based on the uploaded|as a placeholder)\b')) as bigint) as leaked from conversations group by role""")
def leak_guard(spark, sf_dir):
    return audits.leak_guard(read(spark, sf_dir, "conversations"))


@job("provenance_audit", """select source as form_id, count(*) as n, cast(count(*) filter (doc_id % 3 = 0 and doc_id % 5 <> 0) as bigint) as violations from documents group by source""")
def provenance_audit(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise("a guess")
    state = F.when(F.col("doc_id") % 3 == 0, "from documents").otherwise("draft")
    return audits.provenance_audit(read(spark, sf_dir, "documents").select(F.col("source").alias("form_id"), F.col("doc_id").alias("q_idx"), state.alias("state"), name.alias("source")))


_STATE = "case when doc_id % 11 = 0 then 'manual only' when doc_id % 7 = 0 then 'conflict' when n_chars < 300 then 'needs input' when doc_id % 2 = 0 then 'from documents' else 'from profile' end"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    state = audits.answer_state(
        F.col("doc_id") % 11 == 0, F.col("doc_id") % 7 == 0, F.when(F.col("n_chars") >= 300, F.col("lang")),
        F.when(F.col("doc_id") % 2 == 0, "a.pdf").otherwise("profile"), F.lit(False), F.lit(False), F.lit(False),
    )
    return d.select(F.col("source").alias("form_id"), F.col("doc_id").alias("q_idx"), state.alias("state"))


@job("state_distribution", f"""select source as form_id, state, count(*) as n, cast(grouping(source, state) as bigint) as level from (select source, {_STATE} as state from documents) group by rollup (source, state)""")
def state_distribution(spark, sf_dir):
    return audits.state_distribution(_answers(spark, sf_dir))


@job("answer_state", f"""select source as form_id, doc_id as q_idx, {_STATE} as state from documents""")
def answer_state(spark, sf_dir):
    return _answers(spark, sf_dir)


@job("report_gate", f"""select form_id, cast(0 as bigint) as drafts, cast(count(*) filter (state = 'conflict') as bigint) as conflicts, cast(count(*) filter (state = 'needs input') as bigint) as needs_input,
  count(*) filter (state in ('conflict', 'needs input')) = 0 as verified from (select source as form_id, {_STATE} as state from documents) group by form_id""")
def report_gate(spark, sf_dir):
    return audits.report_gate(_answers(spark, sf_dir))


@job("section_fingerprint", """select conv_id, count(*) as n, sha256(string_agg(sha256(coalesce(text, '')), '|' order by turn)) as fingerprint from conversations group by conv_id""")
def section_fingerprint(spark, sf_dir):
    return audits.section_fingerprint(read(spark, sf_dir, "conversations"))


@job("section_changes", """select conv_id, turn, role, coalesce(role <> lag(role) over (partition by conv_id order by turn), true) as changed from conversations""")
def section_changes(spark, sf_dir):
    return audits.section_changes(read(spark, sf_dir, "conversations"))


@job("fuzzy_pairs", """with p as (select p_partkey as id, p_brand || p_size as block, trim(regexp_replace(lower(trim(p_name)), '[*?!.,:;]+$', '')) as l, length(p_name) as n from part)
  select a.id as a, b.id as b, round(1 - levenshtein(a.l, b.l) / greatest(length(a.l), length(b.l)), 6) as score from p a join p b on a.block = b.block and a.id < b.id
  where least(a.n, b.n) >= greatest(a.n, b.n) * 0.6 and round(1 - levenshtein(a.l, b.l) / greatest(length(a.l), length(b.l)), 6) >= 0.6""")
def fuzzy_pairs(spark, sf_dir):
    labels = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("block"), F.col("p_name").alias("label"))
    return similarity.fuzzy_pairs(labels, 0.6)


# Pages and nesting


@job("url_language_hint", r"""select page_id, nullif(lower(regexp_extract(html, '<html[^>]*\slang="([A-Za-z]{2,3})', 1)), '') as language from pages""")
def url_language_hint(spark, sf_dir):
    return pages.url_language_hint(read(spark, sf_dir, "pages"))


_PATTERNS = ["https://*.example.com/*", "*://*.example.org/en/*", "http://*.example.net/fr/*7", "HTTPS://thther.example.org", "no pattern", "*://*/es/4*.html"]


@job("url_coverage", rf"""with p as (select regexp_extract(lower(unnest({_PATTERNS})), '^(\*|[a-z][a-z0-9+.-]*)://([^/]*)(/.*)?$', ['s', 'h', 'p']) as g),
  q as (select g.s as s, g.h as h, '^' || replace(regexp_escape(case when g.p = '' then '/*' else g.p end), '\*', '.*') || '$' as re from p where g.s <> ''),
  u as (select url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)', ['s', 'h', 'p']) as u from pages),
  v as (select url, lower(u.s) as s, regexp_replace(lower(u.h), ':[0-9]+$', '') as h, case when u.p = '' then '/' else u.p end as p from u where u.s <> '')
  select s || '://' || h as origin, count(*) as n from v where not exists (select 1 from q where (q.s = '*' or q.s = v.s) and (q.h = '*' or q.h = v.h or (starts_with(q.h, '*.') and (v.h = q.h[3:] or ends_with(v.h, q.h[2:])))) and regexp_matches(v.p, q.re)) group by 1""")
def url_coverage(spark, sf_dir):
    patterns = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    return pages.url_coverage(read(spark, sf_dir, "pages").select("url"), patterns)


_NODES = """(select r_regionkey as id, cast(null as bigint) as parent, r_regionkey as ord from region union all select 1000000000 + n_nationkey, n_regionkey, 25 - n_nationkey from nation
  union all select 2000000000 + c_custkey, 1000000000 + c_nationkey, case when c_custkey % 6 > 0 then c_custkey end from customer union all select 3000000000 + o_orderkey, 2000000000 + o_custkey + case when o_orderkey % 50 = 0 then 900000000 else 0 end, o_orderkey % 3 from orders
  union all select 4000000000 + s_suppkey, case when s_suppkey % 10 < 2 then 4000000000 + s_suppkey + 1 - 2 * (s_suppkey % 2) when s_suppkey % 10 = 2 then 4000000000 + s_suppkey - 1 else 4000000000 + s_suppkey - 1 end, 1 from supplier)"""


@job("hierarchy_splice", f"""with recursive t as materialized (select t.*, p.id is null and t.parent is not null as orphan from {_NODES} t left join (select id from {_NODES}) p on p.id = t.parent),
  w as (select id, id as root, 0 as depth, orphan, ord, [[0, case when ord is null then 1 else 0 end, coalesce(ord, 0), id]] as path, parent from t where parent is null or orphan
    union all select t.id, w.root, w.depth + 1, false, t.ord, list_append(w.path, [0, case when t.ord is null then 1 else 0 end, coalesce(t.ord, 0), t.id]), t.parent from w join t on t.parent = w.id)
  select id, root, depth, row_number() over (partition by root order by path) as position, case when orphan then 'orphan' when ord is null and parent is not null then 'unplaced' end as note from w
  union all select id, null, null, null, 'cycle' from t where id not in (select id from w)""")
def hierarchy_splice(spark, sf_dir):
    """Regions, nations, customers, orders, some of them of unknown customers, and suppliers in chains that end in cycles of two."""
    for t in ("region", "nation", "customer", "orders", "supplier"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"splice_{t}")
    text = _NODES
    for t in ("region", "nation", "customer", "orders", "supplier"):
        text = text.replace(f"from {t}", f"from splice_{t}")
    nodes = spark.sql(f"select * from {text}")
    return pages.hierarchy_splice(nodes, lambda df: written(df, "splice"))


@job("reading_order", """select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_tax = 0, case when l_tax <> 0 then round(l_quantity / 8) end, l_extendedprice, l_linenumber) as position from lineitem""")
def reading_order(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("top"), F.col("l_extendedprice").alias("left"), F.col("l_linenumber").alias("doc_order"))
    return pages.reading_order(items, "l_orderkey").select("l_orderkey", "l_linenumber", "position")


# Questions: turns of conversations; their rules and facts come from other tables


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "paragraph").when(F.col("turn") % 3 == 1, "short_answer").otherwise("file")
    return c.select(
        F.col("conv_id").alias("form_id"), F.col("turn").alias("q_idx"), (F.col("conv_id") % 25).cast("long").alias("set_id"), (F.col("turn") % 4).cast("long").alias("key"),
        F.col("text").alias("label"), kind.alias("kind"), (F.col("conv_id") % 13 == 5).alias("manual_only"),
    )


_Q = """(select conv_id as form_id, turn as q_idx, conv_id % 25 as set_id, turn % 4 as key, text as label,
  case turn % 3 when 0 then 'paragraph' when 1 then 'short_answer' else 'file' end as kind, conv_id % 13 = 5 as manual_only from conversations)"""


@job("semantic_key_join", rf"""with k as (select item_id % 20 as key, item_id as ord, trim(regexp_replace(translate(lower(string_split(text, ' ')[2]), '{questions.ACCENTED}', '{questions.PLAIN}'), '\s+', ' ', 'g')) as keyword from benchmark),
  l as (select distinct label, trim(regexp_replace(translate(lower(label), '{questions.ACCENTED}', '{questions.PLAIN}'), '\s+', ' ', 'g')) as low from {_Q}),
  h as (select label, key, row_number() over (partition by label order by length(keyword) desc, ord) as r from l join k on contains(low, keyword))
  select form_id, q_idx, h.key from {_Q} q left join h on h.label = q.label and r = 1""")
def semantic_key_join(spark, sf_dir):
    rules = read(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("key"), F.split("text", " ")[1].alias("keyword"), F.col("item_id").alias("ord"))
    return questions.semantic_key_join(_questions(spark, sf_dir).drop("key"), rules).select("form_id", "q_idx", "key")


@job("compose_eligible", f"""select form_id, cast(count(*) filter (not manual_only and (kind = 'paragraph' or (kind = 'short_answer' and regexp_matches(lower(label), '{questions.OPEN_HINTS}') and not regexp_matches(lower(label), '{questions.DISCRETE_HINTS}')))) as bigint) as n
  from {_Q} group by form_id""")
def compose_eligible(spark, sf_dir):
    q = _questions(spark, sf_dir)
    ok = questions.composable(F.col("kind"), F.coalesce("label", F.lit("")), F.col("manual_only"))
    return q.groupBy("form_id").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("n"))


_DECLARED = "coalesce(" + ", ".join(f"case when regexp_matches(label, '{p}') then '{k}' end" for k, p in questions.DECLARATIONS) + ")"


@job("declaration_match", f"""select coalesce({_DECLARED}, 'none') as declaration, count(*) as n from {_Q} group by 1""")
def declaration_match(spark, sf_dir):
    kind = F.coalesce(questions.declaration_kind(F.col("label")), F.lit("none"))
    return _questions(spark, sf_dir).groupBy(kind.alias("declaration")).agg(F.count("*").alias("n"))


@job("resolution_waterfall", f"""with q as {_Q}, f as (select n_nationkey as set_id, n_regionkey as key, arg_max(n_name, n_nationkey) as fact from nation group by all),
  g as (select conv_id as form_id, turn as q_idx, role as given from conversations where turn % 5 = 3)
  select q.form_id, q.q_idx, case when manual_only then 'manual' when fact is not null then 'facts' when {_DECLARED} = 'certification' then 'declaration' when given is not null then 'supplied' when kind = 'file' then 'file' else 'needs input' end as tier,
    case when not manual_only then coalesce(fact, case when {_DECLARED} = 'certification' then 'yes' end, given) end as answer
  from q left join f on f.set_id = q.set_id and f.key = q.key left join g on g.form_id = q.form_id and g.q_idx = q.q_idx""")
def resolution_waterfall(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    known = n.select(F.col("n_nationkey").cast("long").alias("set_id"), F.col("n_regionkey").cast("long").alias("key"), F.col("n_name").alias("value"), F.lit("high").alias("confidence"))
    defaults = spark.createDataFrame([("certification", "yes")], "declaration string, value string")
    c = read(spark, sf_dir, "conversations").where("turn % 5 in (3, 4)")
    given = c.select(F.col("conv_id").alias("form_id"), F.col("turn").alias("q_idx"), F.col("role").alias("value"), F.when(F.col("turn") % 5 == 3, "cv.pdf").otherwise("memory").alias("source"))
    return questions.resolution_waterfall(_questions(spark, sf_dir), known, defaults, given)


# Evidence of orders: the priority spelt out, and its initials from the same file or another; the documents of a third of the sets link them.

@job("evidence_agreement", r"""with e as (select o_orderkey as id, o_custkey % 3 as s, o_orderkey % 4 as k, regexp_extract(o_orderpriority, '([A-Z])', 1) <> '' as lettered from orders)
  select id as answer_id, case k when 0 then lettered when 1 then lettered and s = 0 when 2 then true else false end as agree, cast(case when k = 0 then 1 else 2 end as bigint) as files from e""")
def evidence_agreement(spark, sf_dir):
    name = F.regexp_replace("o_orderpriority", "[^A-Za-z ]", "")
    spelt = F.concat(F.lit("Office of "), F.trim(name), F.lit(" and Urgent Delivery"))
    words = F.filter(F.split(F.lower(F.trim(name)), " +"), lambda w: w != "")
    short = F.concat(F.lit("o"), F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""), F.lit("ud"))
    k, row = F.col("o_orderkey") % 4, lambda i, source, value: F.struct(F.lit(i).cast("long").alias("seq"), F.lit(source).alias("source"), value.alias("value"))
    told = F.when(k == 0, F.array(row(1, "cv.pdf", short), row(2, "cv.pdf", spelt))).when(k == 1, F.array(row(1, "cv.pdf", spelt), row(2, "b.pdf", F.upper(short)))).when(k == 2, F.array(row(1, "cv.pdf", spelt), row(2, "b.pdf", F.upper(spelt)))).otherwise(F.array(row(1, "cv.pdf", spelt), row(2, "b.pdf", F.lit("xyz"))))
    orders = read(spark, sf_dir, "orders").withColumn("set_id", F.col("o_custkey") % 3)
    rows = orders.select(F.col("o_orderkey").alias("answer_id"), "set_id", F.explode(told).alias("e")).select("answer_id", "set_id", "e.*")
    far = F.when(F.col("set_id") == 0, F.lit(" (")).otherwise(F.lpad(F.lit(" "), 90, "."))
    texts = orders.select("set_id", F.col("o_orderkey").alias("file_name"), F.concat(F.lit("At the "), F.upper(spelt), far, short, F.lit("), since 2001")).alias("text"))
    links = questions.acronym_links(rows, texts.where("file_name % 4 = 2"))
    return questions.evidence_agreement(rows, links).select("answer_id", "agree", "files")


@job("commit_reviews", """with s as (select c_custkey as f, c_mktsegment as v from customer where c_custkey % 3 <> 0), r as (select c_custkey as f, case when c_custkey % 4 = 0 then ' ' when c_custkey % 4 = 1 then c_mktsegment else c_name end as v from customer where c_custkey % 2 = 0 or c_custkey % 4 = 1),
  t as (select * from r where trim(v) <> '')
  select coalesce(s.f, t.f) as form_id, 0 as q_idx, coalesce(t.v, s.v) as value, t.v is not null and t.v is distinct from s.v as committed from s full join t on s.f = t.f""")
def commit_reviews(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id"), F.lit(0).alias("q_idx"), "c_mktsegment", "c_name")
    k = F.col("form_id") % 4
    reviews = c.where((F.col("form_id") % 2 == 0) | (k == 1)).withColumn("value", F.when(k == 0, " ").when(k == 1, F.col("c_mktsegment")).otherwise(F.col("c_name")))
    return questions.commit_reviews(c.where("form_id % 3 <> 0").withColumn("value", F.col("c_mktsegment")), reviews)


@job("budget_cut", """select conv_id as form_id, turn as q_idx, row_number() over (partition by conv_id order by turn) <= 3 as sent from conversations""")
def budget_cut(spark, sf_dir):
    return questions.budget_cut(_questions(spark, sf_dir).select("form_id", "q_idx"), 3)


@job("removed_frames", """select distinct user_id as key from events where ts < timestamp '2024-01-10' and event_type = 'click' and user_id not in (select user_id from events where ts >= timestamp '2024-01-25' and event_type = 'click')""")
def removed_frames(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'click'")
    return forms.removed_frames(e.where("ts < timestamp_ntz'2024-01-10'"), e.where("ts >= timestamp_ntz'2024-01-25'"))


@job("retry_set", """select distinct user_id % 50 as question from events where event_type in ('error') and value > 20""")
def retry_set(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("question", F.col("key") % 50)
    log = e.select("question", F.when((F.col("event_type") == "error") & (F.col("value") > 20), "failed").otherwise("filled").alias("outcome"))
    return forms.retry_set(e.select("question").distinct(), log)


@job("fill_outcomes", """with l as (select user_id % 5 as frame, case event_type when 'purchase' then 'filled' when 'error' then 'failed' else 'skipped' end as outcome, event_type as reason from events),
  c as (select frame, outcome, reason, count(*) as n from l group by all)
  select frame, outcome, reason, n, row_number() over (partition by frame order by case outcome when 'failed' then 0 when 'skipped' then 1 else 2 end, n desc, reason) as place from c""")
def fill_outcomes(spark, sf_dir):
    t = F.col("event_type")
    outcome = F.when(t == "purchase", "filled").when(t == "error", "failed").otherwise("skipped")
    return forms.fill_outcomes(events(spark, sf_dir).select((F.col("key") % 5).alias("frame"), outcome.alias("outcome"), t.alias("reason")))


@job("fillable_answers", f"""select q.form_id, q.q_idx, c.role as value from {_Q} q join conversations c on c.conv_id = q.form_id and c.turn = q.q_idx where not manual_only and trim(c.role) <> ''""")
def fillable_answers(spark, sf_dir):
    answers = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("form_id"), F.col("turn").alias("q_idx"), F.col("role").alias("value"))
    return questions.fillable_answers(answers, _questions(spark, sf_dir))


@job("unresolved_questions", f"""select form_id, q_idx from {_Q} where not manual_only and kind <> 'file' and not (q_idx = 0)""")
def unresolved_questions(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.unresolved_questions(q, q.where("q_idx = 0")).select("form_id", "q_idx")


@job("boundary_leak_check", f"""select form_id, q_idx from {_Q} where not manual_only and kind = 'paragraph'""")
def boundary_leak_check(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.boundary_leak_check(q.where("not manual_only and kind = 'paragraph'").select("form_id", "q_idx"), q)


@job("placeholder_options", r"""select p_partkey as id, list_filter([p_brand, case when p_size % 3 = 0 then 'Select one' else p_type end, '--', p_name], lambda x: not regexp_full_match(trim(x), '(?i)(select|choose|please select|pick)\b.*|[\p{P}\s]*')) as kept from part""")
def placeholder_options(spark, sf_dir):
    second = F.when(F.col("p_size") % 3 == 0, "Select one").otherwise(F.col("p_type"))
    lists = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", second, F.lit("--"), "p_name").alias("options"))
    return questions.placeholder_options(lists)


@job("option_resolve", r"""with v as (select p_partkey as id, p_size as set_id, trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')) as v from part),
  o as (select p_size as set_id, p_partkey as pos, p_type as option, trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')) as o from part),
  s as (select id, pos, option, v, o, 1 - levenshtein(v, o) / greatest(length(v), length(o)) as sc from v join o using (set_id)),
  t as (select *, case when v = o then 1 when least(length(v), length(o)) >= 3 and (contains(' ' || v || ' ', ' ' || o || ' ') or contains(' ' || o || ' ', ' ' || v || ' ')) then 2 when sc >= 0.8 then 3 end as tier from s),
  r as (select *, row_number() over (partition by id order by tier, sc desc, pos) as n from t where tier is not null)
  select v.id, option, tier from v left join r on r.id = v.id and n = 1""")
def option_resolve(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    options = p.select(F.col("p_size").alias("set_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("option"))
    return questions.option_resolve(p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("set_id"), F.col("p_type").alias("value")), options)


@job("file_inventory", """with f as (select case doc_id % 4 when 0 then 'pdf' when 1 then 'text' when 2 then 'media' else 'unsupported' end as kind, n_chars as l from documents)
  select kind, count(*) as n, cast(sum(l) as bigint) as bytes, cast(count(*) filter (l = 0 or l > case kind when 'pdf' then 5000 when 'media' then 1000 else 20000 end) as bigint) as rejected from f group by kind""")
def file_inventory(spark, sf_dir):
    k = F.col("doc_id") % 4
    name = F.concat(F.col("doc_id").cast("string"), F.when(k == 0, ".PDF").when(k == 1, ".txt").when(k == 2, ".mp4").otherwise(".bin"))
    files = read(spark, sf_dir, "documents").select(name.alias("file_name"), F.col("n_chars").alias("length"))
    return sources.file_inventory(files, pdf_limit=5000, any_limit=20_000, media_limit=1000)


# Streams, drained over the same events as their batch twins


#: Rows of a file of a stream at least, if its part has several: so many that by their hash no file gets none.
FILE_ROWS = 10_000


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The event table as a stream of five parts, one a trigger, and a folder for state and rows.

    Parts follow each other in time, but a third of the rows of the last hour of each comes with the next. A sixth part has one event of no
    key two days after all others, with which the watermark passes them. A part of many rows is many files, the same number in each but the last.
    """
    path = work_folder(spark, "stream")
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    span = F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1
    slot = lambda t: F.floor((F.unix_micros(t) - F.unix_micros(F.lit(low))) * 5 / span).cast("int")
    late = (F.col("event_id") % 3 == 0) & (slot(F.col("ts") + F.expr("interval 1 hour")) > slot(F.col("ts")))
    rows = written(rows.withColumn("slot", slot(F.col("ts")) + late.cast("int")), "slots")
    sizes = {r["slot"]: r["count"] for r in rows.groupBy("slot").count().collect()}
    files = max(1, min(2 * spark.sparkContext.defaultParallelism, *(sizes.get(i, 0) // FILE_ROWS for i in range(5))))
    for i in range(6):
        last = i == 5
        part = rows.where(F.col("slot") >= i) if last else rows.where(F.col("slot") == i)
        if last:
            part = part.unionByName(rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("key"), F.lit(high + datetime.timedelta(days=2)).alias("ts"), F.lit("end").alias("event_type"), F.lit(5).alias("slot")))
        part = part.drop("slot")
        (part.repartition(files, "event_id") if files > 1 else part.coalesce(1)).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(rows.drop("slot").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{path}/in"), path


@job("stream_ledger", f"""select user_id as key, {DAY} as day, count(*) as used from events group by all""")
def stream_ledger(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    out = streams.drained(spark, streams.day_counts(rows), path, "update").where("key is not null")
    return out.groupBy("key", F.col("day").cast("string").alias("day")).agg(F.max_by("used", "_batch").alias("used"))


@job("stream_rate", """with s as (select user_id as key, epoch_us(ts) as us from events), w as (select key, us, unnest(range(0, 6)) as i from s),
  c as (select key, (us // 600000000 - i) * 600000000 as start, count(*) as n from w group by all)
  select key, cast(make_timestamp(start) as varchar) as start, n from c where n > 1""")
def stream_rate(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    out = streams.drained(spark, grouped.rate_alerts(rows, rpm=3, window="1 hour", slide="10 minutes"), path, "update").where("key is not null")
    return out.groupBy("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start")).agg(F.max_by("n", "_batch").alias("n"))


@job("stream_dedupe", """with recursive e as (select event_id, user_id || event_type as key, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id || event_type order by ts, event_id) as n from events),
  r as (select key, event_id, ms, n from e where n = 1
    union all select r.key, x.event_id, x.ms, x.n from r join lateral (select event_id, ms, n from e where e.key = r.key and e.n > r.n and e.ms - r.ms > 7200000 order by n limit 1) x on true)
  select key, event_id from r""")
def stream_dedupe(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    jobs = rows.select("event_id", F.concat(F.col("key").cast("string"), "event_type").alias("key"), "ts")
    return streams.drained(spark, ordered.admitted_once(jobs, 7_200_000), path, "append").where("key is not null").select("key", "event_id")


@job("stream_ttl", """with e as (select user_id as key, ts, lag(ts) over (partition by user_id order by ts) as p from events),
  i as (select key, ts, sum(case when p is null or ts >= p + interval 6 hours then 1 else 0 end) over (partition by key order by ts rows unbounded preceding) as s from e)
  select key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as expires_at, count(*) as n from i group by key, s""")
def stream_ttl(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    out = streams.drained(spark, grouped.lives(rows.select("key", "ts"), "6 hours"), path, "append").where("key is not null")
    return out.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), "n")


@job("stream_versions", _VERSIONS)
def stream_versions(spark, sf_dir):
    rows, path = _stream(spark, sf_dir)
    t = F.col("event_type")
    kind = F.when(t == "signup", "navigate").when(t == "view", "scan").when(t == "error", "remove").otherwise("answer")
    return streams.drained(spark, ordered.versions(rows.withColumn("kind", kind), IDLE_MS), path, "append").drop("_batch").where("key is not null")


def queries() -> dict[str, Query]:
    from . import catalog_forms, catalog_reading  # noqa: F401  (they add their jobs)

    return {name: query for name, (query, _) in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in JOBS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed candidates of every document set, corroborated and reconciled into facts."""
    return facts.reconcile_facts(reading.typed(documents(spark, sf_dir)))
