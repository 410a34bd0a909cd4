"""One query for each operator, over whole tables, with production parameters; and their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, chat, decontaminate, filter_audit, line_dedup, merkle, partenum, piece_bpe, pii, quality, token_file, toxicity
from .common import Query, table, work_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(documents, labels.where(third != 1))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_file.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_file.checksums(token_file.read(spark, path))


def op3_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.attribute(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
with c as (select conv_id, turn, case when role is null then '%unknown' when role = '' then '%empty' else
               replace(replace(replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), ' ', '%20'), chr(9), '%09'), chr(10), '%0A'), chr(11), '%0B'), chr(12), '%0C'), chr(13), '%0D') end as speaker,
             regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '<|im_\1 |>', 'g') as said from conversations),
p as (select distinct conv_id as o, speaker as perspective from c where speaker <> 'system'),
j as (select *, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
      from c join p on conv_id is not distinct from o),
h as (select *, case when role = 'user' then speaker end as name,
        '<|im_start|>' || role || case when role = 'user' then ' name=' || speaker else '' end || chr(10) as head from j)
select conv_id, perspective, turn, role, name, head || said || '<|im_end|>' || chr(10) as segment,
  cast(case when role = 'assistant' then length(head) else 0 end as bigint) as mask_start,
  cast(case when role = 'assistant' then length(head) + length(said) + 10 else 0 end as bigint) as mask_end,
  role = 'assistant' as trained from h
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with l as (select doc_id, pos - 1 as no, lines[pos] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as pos from (select doc_id, string_split(text, chr(10)) as lines from documents))),
w as (select doc_id, no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from l),
g as (select doc_id, no, list_sort(list_distinct(w)) as s from w where len(w) > 0),
k as (select array_to_string(s, chr(10)) as k, any_value(s) as s, min(doc_id * 1000000 + no) as first from g group by 1),
t as (select k, first, len(s) as n, unnest(s) as t from k),
c as (select b.k as k, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.t = b.t and a.first < b.first and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by a.k, b.k),
x as (select distinct k from c where 100 * common >= 80 * (na + nb - common)),
r as (select doc_id, no from g join k on array_to_string(g.s, chr(10)) = k.k where k.k in (select k from x) or doc_id * 1000000 + no <> first),
o as (select l.doc_id, count(*) as n_lines, count(r.no) as n_removed, coalesce(string_agg(line, chr(10) order by l.no) filter (r.no is null), '') as kept
      from l left join r on l.doc_id = r.doc_id and l.no = r.no group by l.doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join o using (doc_id)
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.scan(documents, pii.train(documents))


ALNUM = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP4_SQL = f"""
with d as (select doc_id, {ALNUM} as w from documents),
b as (select item_id, {ALNUM} as w from benchmark),
bw as (select distinct item_id, len(list_slice(w, pos, least(pos + 9, len(w)))) as n, array_to_string(list_slice(w, pos, least(pos + 9, len(w))), ' ') as win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as pos from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from d, sizes where len(w) >= n)),
m as (select doc_id, pos, bw.n as n, item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
      from (select distinct doc_id, cast(item_id as varchar) as i from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, least(p + 4, len(w))), ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, m.component_id from d left join n using (doc_id) join m using (doc_id)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
tri as (select r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as p from d where len(w) >= 3)),
rep as (select r, p from (select r, p, count(*) over (partition by r, g) as c from tri) where c > 1),
cov as (select r, count(distinct q) as n from (select r, unnest(range(p, p + 3)) as q from rep) group by r),
m as (select d.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from d left join cov using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when n_words > 0 then 1000 * word_chars // n_words else 0 end as word_len,
        case when word_chars > 0 then 10000 * n_symbols // word_chars else 0 end as symbols,
        case when n_lines > 0 then 10000 * n_dup_lines // n_lines else 0 end as dup_lines,
        case when n_words > 0 then 10000 * n_repeat_words // n_words else 0 end as repeats from m),
u as (select lang, source, 'word_len' as metric, word_len as v from f where not base_failed
  union all select lang, source, 'symbols', symbols from f where not base_failed
  union all select lang, source, 'dup_lines', dup_lines from f where not base_failed
  union all select lang, source, 'repeats', repeats from f where not base_failed),
b as (select lang, source, metric, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) as v from u),
l as (select lang, metric, v, count(*) as n, sum(count(*)) over (partition by lang, metric) as t from b group by lang, metric, v),
g as (select lang, source, metric, v, count(*) as n from b group by all),
x as (select d.lang, d.source, d.metric, l.v, l.t, sum(coalesce(g.n, 0)) over w as own, sum(l.n) over w as every, sum(coalesce(g.n, 0)) over (partition by d.lang, d.source, d.metric) as size
      from (select distinct lang, source, metric from b) d join l on l.lang = d.lang and l.metric = d.metric left join g on g.lang = d.lang and g.source = d.source and g.metric = d.metric and g.v = l.v
      window w as (partition by d.lang, d.source, d.metric order by l.v)),
z as (select lang, source, metric, min(v) filter (4 * (own * t + 50 * every) >= (size + 50) * t) as q1, min(v) filter (4 * (own * t + 50 * every) >= 3 * (size + 50) * t) as q3 from x group by all),
k as (select lang, source,
        max(q1 - 3 * (q3 - q1) - 500) filter (metric = 'word_len') as wl, max(q3 + 3 * (q3 - q1) + 500) filter (metric = 'word_len') as wh,
        max(q3 + 3 * (q3 - q1) + 200) filter (metric = 'symbols') as sh, max(q3 + 3 * (q3 - q1) + 6000) filter (metric = 'dup_lines') as dh,
        max(q3 + 3 * (q3 - q1) + 3000) filter (metric = 'repeats') as rh from z group by all)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and coalesce(word_len between wl and wh and symbols <= sh and dup_lines <= dh and repeats <= rh, false) as kept
from f left join k using (lang, source)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(documents, filter_audit.RULES, labels)


OP11_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
e as (select t, min(doc_id) as first from d group by t),
y as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
        || case when 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) then 'C' else '' end
        || case when regexp_matches(d.t, '[#$%&*|]') then 'D' else '' end || case when d.doc_id > e.first then 'E' else '' end as fails
      from d join e on d.t = e.t left join y on y.doc_id = d.doc_id),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select '' as o union all select o || f from o, l where not contains(o, f)),
s as (select o as filter_order, cast(p as integer) as step, o[p] as f, o[1:p - 1] as before from o, range(1, 6) as x(p) where length(o) = 5),
j as (select part, filter_order, step, f,
        sum(case when fails = '' or length(translate(fails, before || f, '')) = length(fails) then n else 0 end) as kept,
        sum(case when contains(fails, f) and length(translate(fails, before, '')) = length(fails) then n else 0 end) as removed,
        sum(case when contains(fails, f) and length(translate(fails, before, '')) < length(fails) then n else 0 end) as redundant,
        sum(case when fails = f then n else 0 end) as unique_fails,
        sum(case when contains(fails, f) and length(translate(fails, before, '')) = length(fails) then good else 0 end) as good_lost,
        sum(case when contains(fails, f) and length(translate(fails, before, '')) = length(fails) then toxic else 0 end) as toxic_lost
      from c, s group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley from j
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    held = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(documents, held=held, with_paths=False)


_FIELD = "coalesce(cast(strlen(cast({0} as varchar)) as varchar) || ':' || cast({0} as varchar), '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text"))

OP13_SQL = f"""
with recursive crc as (select list(v order by i) as crcs from (select i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end)) as v from range(256) as x(i))),
h as (select *, list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda c, b: xor(c >> 8, crcs[xor(c, b) % 256 + 1])) as c from documents, crc),
l as (select row_number() over () as r, doc_id, lang, sha256({_ROW.format("n_chars")}) as leaf, sha256({_ROW.format("case when xor(c, 4294967295) % 7 = 0 then n_chars + 1 else n_chars end")}) as held from h),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
u as (select lang, 0 as level, pos as i, leaf as d, n from p
  union all select lang, level + 1, i // 2, sha256(string_agg(d, '' order by i)), (n + 1) // 2 from u where n > 1 group by lang, level, i // 2, n),
q as (select lang, d, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n, level from u where n = 1),
v as (select 0 as level, pos as i, d, n from q
  union all select level + 1, i // 2, sha256(string_agg(d, '' order by i)), (n + 1) // 2 from v where n > 1 group by level, i // 2, n),
s as (select p.r, u.level, p.pos >> u.level as own, u.i, u.d from p join u on p.lang is not distinct from u.lang and u.i // 2 = p.pos >> (u.level + 1) and u.n > 1
  union all select p.r, q.level + v.level, q.pos >> v.level, v.i, v.d from p join q on p.lang is not distinct from q.lang join v on v.i // 2 = q.pos >> (v.level + 1) and v.n > 1),
k as (select r, level, coalesce(max(d) filter (i < own), '') as before, coalesce(max(d) filter (i > own), '') as after from s group by r, level),
f as (select r, 0 as level, held as d from p
  union all select f.r, f.level + 1, sha256(before || d || after) from f join k on f.r = k.r and f.level = k.level),
o as (select r, string_agg(before || after, '' order by level) as proof from k group by r)
select p.doc_id, p.leaf, q.d as subroot, v.d as root, sha256(coalesce(proof, '')) as proof_sha256, g.d as folded_root, g.d = v.d as verified
from p join q on p.lang is not distinct from q.lang join v on v.n = 1 left join o on o.r = p.r join (select r, max_by(d, level) as d from f group by r) g on g.r = p.r
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_toxicity": op1_toxicity,
        "op2_token_file": op2_token_file,
        "op3_token_attribution": op3_token_attribution,
        "op4_decontamination": op4_decontamination,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_chat_rotation": op6_chat_rotation,
        "op7_quality_rules": op7_quality_rules,
        "op8_line_dedup": op8_line_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_pii": op10_pii,
        "op11_filter_audit": op11_filter_audit,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_chat_rotation": OP6_SQL, "op7_quality_rules": OP7_SQL, "op8_line_dedup": OP8_SQL,
        "op11_filter_audit": OP11_SQL, "op13_merkle": OP13_SQL,
    }
