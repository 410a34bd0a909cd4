"""Jobs on forms, options, answers and frames. Stand-ins are made of customers, parts, orders, events, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .catalog import events, job, read, written
from .operators import audits, forms, ledgers, matching, questions, similarity
from .plans import resolution
from .sources import html
from .work import spread


def _keep(df: DataFrame) -> DataFrame:
    return written(df, "rounds")


# Fields of pages: for each customer a page of two forms, as crawled HTML

_HTML = r"""concat('<html><body><input name="q" placeholder="Search">',
  case when c_custkey % 5 = 4 then '' else concat('<form><label for="n', c_custkey, '">Full name</label><input id="n', c_custkey, '" name="name" required>',
    '<label>Segment <select name="seg"><option>Select one</option><option>', c_mktsegment, '</option><option>Other</option></select></label>',
    '<fieldset><legend>Size</legend><input type="radio" name="size" aria-label="Small"><input type="radio" name="size" aria-label="Large" required></fieldset>',
    case when c_custkey % 3 = 0 then '<input type="password" name="pw" aria-label="Password">' else '<textarea name="why" aria-label="Why?"></textarea>' end, '<input type="hidden" name="t"><input type="submit"></form>') end,
  case when c_custkey % 2 = 0 then '<form><input name="card_number" placeholder="Card number"></form>' else '' end, '</body></html>')"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers spread over all tasks before pages are made of them: a page is a hundred times its customer and takes a parser's time."""
    return spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.expr(_HTML).alias("html"))


# (page, seq, form, type, name, label): the fields that the pages above hold
_FIELDS = """(with c as (select c_custkey as p, c_custkey % 5 < 4 as big, c_custkey % 3 = 0 as pw, c_custkey % 2 = 0 as card from customer)
  select p as page_id, 0 as seq, null as form, 'text' as type, 'q' as name, 'Search' as label, false as required from c
  union all select p, 1, 0, 'text', 'name', 'Full name', true from c where big union all select p, 2, 0, 'select', 'seg', 'Segment', false from c where big
  union all select p, 3, 0, 'radio', 'size', 'Small', false from c where big union all select p, 4, 0, 'radio', 'size', 'Large', true from c where big
  union all select p, 5, 0, case when pw then 'password' else 'paragraph' end, case when pw then 'pw' else 'why' end, case when pw then 'Password' else 'Why?' end, false from c where big
  union all select p, case when big then 6 else 1 end, case when big then 1 else 0 end, 'text', 'card_number', 'Card number', false from c where card)"""


@job("page_fields", f"select page_id, seq, form, type, name, label, required from {_FIELDS}")
def page_fields(spark, sf_dir):
    return html.page_fields(_pages(spark, sf_dir)).select("page_id", "seq", "form", "type", "name", "label", "required")


@job("substantial_forms", f"select page_id, seq, label from {_FIELDS} where page_id % 5 = 4 or form = 0")
def substantial_forms(spark, sf_dir):
    return forms.substantial_forms(html.page_fields(_pages(spark, sf_dir))).select("page_id", "seq", "label")


_REASON = "case when type = 'password' then 'password field' when name = 'card_number' then 'payment card field' end"


@job("manual_only_flags", f"select page_id, seq, {_REASON} as manual_reason from {_FIELDS}")
def manual_only_flags(spark, sf_dir):
    return forms.manual_only_flags(html.page_fields(_pages(spark, sf_dir))).select("page_id", "seq", "manual_reason")


_QUESTIONS = f"""(select page_id, min(seq) as seq, case when type = 'radio' then 'Size' else min(label) end as label,
    case type when 'radio' then 'multiple_choice' when 'select' then 'dropdown' when 'paragraph' then 'paragraph' else 'short_answer' end as type,
    max(required) as required, max({_REASON}) as manual_reason, type = 'radio' as grouped from {_FIELDS} group by page_id, name, type)"""


@job("option_groups", f"""select page_id, seq, label, q.type, case when q.type = 'dropdown' then [c_mktsegment, 'Other'] when grouped then ['Small', 'Large'] else [] end as options, required, manual_reason
  from {_QUESTIONS} q join customer on c_custkey = page_id""")
def option_groups(spark, sf_dir):
    return forms.option_groups(forms.manual_only_flags(html.page_fields(_pages(spark, sf_dir)))).drop("rows")


# Pages of grids, scales and list boxes whose sizes and kinds follow the customer; tags are left open as on real pages
_ODD_PAGE = r"""concat('<html><body><h2>Part ', c_custkey % 3, '</h2><p>How good?<table><tr><th><th>Bad<th>Good',
  array_join(transform(sequence(1, cast(1 + c_custkey % 4 as int)), i -> concat('<tr><th>Row ', i, if(c_custkey % 2 = 0, concat('<td><input type=radio name=r', i, '><td><input type=radio name=r', i, '>'), '<td><input type=checkbox><td><div role=checkbox></div>'))), ''),
  '</table><fieldset><legend>Rate ', c_mktsegment, '</legend>', array_join(transform(sequence(1, cast(2 + c_custkey % 5 as int)), i -> concat('<label><input type=radio name=s>', i, if(c_custkey % 7 = 0 and i = 2, ' best', ''))), ''),
  '</fieldset><ul role=listbox aria-label="City ', c_custkey, '"><li role=option>Choose<li role=option>', c_mktsegment, '<li role=option>Other</ul><input role=combobox aria-labelledby="t u"><span id=t>Town</span> <b id=u>now',
  case when c_custkey % 3 = 0 then '<div>About you</div><li><div role=spinbutton></div>' else '</b><input name="freeText_2">' end)"""


@job("page_structure", r"""with c as (select c_custkey as p, c_mktsegment as m, list_transform(range(1, 2 + c_custkey % 4), lambda i: 'Row ' || i) as rs, list_transform(range(1, 3 + c_custkey % 5), lambda i: i || case when c_custkey % 7 = 0 and i = 2 then ' best' else '' end) as ss from customer),
  q as (select p, 0 as seq, 'How good?' as label, case when p % 2 = 0 then 'multiple_choice_grid' else 'checkbox_grid' end as type, ['Bad', 'Good'] as options, rs as rows from c
    union all select p, 1, 'Rate ' || m, case when p % 7 = 0 then 'multiple_choice' else 'linear_scale' end, ss, [] from c
    union all select p, 1 + len(ss), 'City ' || p, 'dropdown', [m, 'Other'], [] from c union all select p, 2 + len(ss), case when p % 3 = 0 then 'Town nowAbout you' else 'Town now' end, 'dropdown', [], [] from c
    union all select p, 3 + len(ss), case when p % 3 = 0 then 'About you' else 'now' end, case when p % 3 = 0 then 'paragraph' else 'short_answer' end, [], [] from c)
  select p as page_id, seq, label, type, options, rows, type not like '%grid' and seq <> 1 as open from q""")
def page_structure(spark, sf_dir):
    """Questions of those pages, and which of them are still open when the scale is answered: never a grid."""
    pages = _customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.expr(_ODD_PAGE).alias("html"))
    asked = written(forms.option_groups(forms.manual_only_flags(html.page_fields(pages))), "asked")
    form = asked.select(F.col("page_id").alias("form_id"), F.col("seq").alias("q_idx"), F.col("manual_reason").isNotNull().alias("manual_only"), F.col("type").alias("kind"))
    left = questions.unresolved_questions(form, form.where("q_idx = 1")).select(F.col("form_id").alias("page_id"), F.col("q_idx").alias("seq"), F.lit(True).alias("left"))
    return asked.join(left, ["page_id", "seq"], "left").select("page_id", "seq", "label", "type", "options", "rows", F.coalesce("left", F.lit(False)).alias("open"))


@job("field_coverage", f"""select page_id, type, count(*) as n, cast(count(manual_reason) as bigint) as manual_only, cast(0 as bigint) as without_options, cast(grouping(page_id, type) as bigint) as level
  from {_QUESTIONS} group by rollup (page_id, type)""")
def field_coverage(spark, sf_dir):
    return forms.field_coverage(forms.option_groups(forms.manual_only_flags(html.page_fields(_pages(spark, sf_dir)))))


# Options and answers: parts and orders


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts spread over all tasks: an answer is compared with every option of its row, in all their forms."""
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), "p_partkey")


@job("option_choice", """select p_partkey as id, case p_partkey % 5 when 0 then 'Brand ' || p_size when 1 then '4+ Years' when 2 then 'ECE' when 3 then 'Computer Science' end as chosen from part""")
def option_choice(spark, sf_dir):
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, F.concat(F.lit("brand  "), "p_size", F.lit("!"))).when(k == 1, "4th Year").when(k == 2, "Electrical and Computer Engineering").when(k == 3, "computer sciense").otherwise("JavaScript")
    options = F.array(F.lit("Java"), F.concat(F.lit("Brand "), "p_size"), F.lit("4+ Years"), F.lit("ECE"), F.lit("Computer Science"))
    return matching.option_choice(_parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), value.alias("value"), options.alias("options")))


@job("option_choices", """select p_partkey as id, case when p_partkey % 2 = 0 then ['Python', p_type] else ['JS'] end as chosen from part""")
def option_choices(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("python, and "), F.lower("p_type"), F.lit("; Cobol / python"))).otherwise("JavaScript")
    options = F.array(F.lit("Java"), F.lit("JS"), F.lit("Python"), F.col("p_type"))
    return matching.option_choice(_parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), value.alias("value"), options.alias("options")), many=True)


@job("option_exact", """select p_partkey as id, case p_partkey % 6 when 0 then 1 when 1 then 0 when 2 then 0 when 3 then 2 end as position,
  case p_partkey % 6 when 0 then 'data-value' when 1 then 'exact-text' when 2 then 'case-insensitive' when 3 then 'whitespace-normalized' end as strategy from part""")
def option_exact(spark, sf_dir):
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, F.concat(F.lit("v"), "p_size")).when(k == 1, F.col("p_name")).when(k == 2, F.upper("p_name")).when(k == 3, "TWO   words").when(k == 4, " ").otherwise(F.concat("p_name", F.lit("x")))
    option = lambda v, t: F.struct(v.cast("string").alias("data_value"), t.alias("label"))
    options = F.array(option(F.lit("first"), F.col("p_name")), option(F.concat(F.lit("v"), "p_size"), F.lit("second")), option(F.lit(None), F.lit(" two words ")))
    return matching.option_exact(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), value.alias("value"), options.alias("options")))


@job("choice_repair", """select o_orderkey as id, case when o_orderkey % 5 in (2, 4) then 'needs_user_input' else 'answered' end as status,
  case o_orderkey % 5 when 0 then o_orderpriority when 1 then o_orderpriority when 3 then o_orderpriority || ', None' else '' end as value, o_orderkey % 5 in (1, 3) as repaired from orders""")
def choice_repair(spark, sf_dir):
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    value = F.when(k == 0, p).when(k == 1, F.lower(p)).when(k == 2, "elsewhere").when(k == 3, F.concat(F.lit('["'), F.lower(p), F.lit('","None","zzz"]'))).otherwise(p)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value.alias("value"), F.when(k == 4, "needs_user_input").otherwise("answered").alias("status"), F.array(p, F.lit("None")).alias("options"))
    return matching.choice_repair(rows)


@job("profile_match", """with c as (select c_custkey, c_custkey % 25 as k, c_custkey % 4 as s, c_mktsegment as seg from customer), q as (select c.*, unnest(['first_name', 'last_name', 'dob_year', 'phone', 'dial_code', 'email', 'gender', 'other_key']) as key from c)
  select c_custkey * 10 + case key when 'first_name' then 0 when 'last_name' then 1 when 'dob_year' then 2 when 'phone' then 3 when 'dial_code' then 4 when 'email' then 5 when 'gender' then 6 else 7 end as q_id,
    case key when 'phone' then 'dial_code' else key end as key,
    case key when 'first_name' then case when s = 0 then null else 'Ann' end when 'last_name' then case when s = 0 then null else seg end when 'dob_year' then '2001' when 'phone' then '+442' when 'dial_code' then '+442' when 'gender' then case when s = 1 then 'Female' end end as value,
    case key when 'first_name' then case when s > 0 then 'cv.pdf' end when 'last_name' then case when s > 0 then 'cv.pdf' end when 'dob_year' then 'id.png' when 'phone' then 'cv.pdf' when 'dial_code' then 'cv.pdf' when 'gender' then case when s = 1 then 'id.png' end end as source,
    case key when 'first_name' then case when s = 0 then 'no fact' else 'matched' end when 'last_name' then case when s = 0 then 'no fact' else 'matched' end when 'email' then 'implausible' when 'gender' then case when s = 1 then 'matched' else 'no option' end when 'other_key' then 'no fact' else 'matched' end as outcome from q""")
def profile_match(spark, sf_dir):
    c = _customers(spark, sf_dir).withColumn("set_id", F.col("c_custkey"))
    low = F.when(F.col("c_custkey") % 4 == 0, "low").otherwise("high")
    row = lambda field, value, source, conf, seq: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), conf.alias("confidence"), F.lit(seq).alias("seq"))
    high, mid = F.lit("high"), F.lit("medium")
    told = F.array(
        row("name", F.concat(F.lit("Ann Bee "), "c_mktsegment"), "cv.pdf", low, 1), row("dob", F.lit("2001-04-03"), "id.png", high, 2), row("dob", F.lit("1999-01-01"), "cv.pdf", mid, 1),
        row("phone", F.lit("+44 20 7946 0000"), "cv.pdf", high, 3), row("email", F.lit("not an address"), "cv.pdf", high, 4), row("gender", F.when(F.col("c_custkey") % 4 == 1, "female").otherwise("unsaid"), "id.png", high, 5),
    )
    facts = c.select("set_id", F.explode(told).alias("f")).select("set_id", "f.*")
    keys = ["first_name", "last_name", "dob_year", "phone", "dial_code", "email", "gender", "other_key"]
    asked = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("i")) for i, k in enumerate(keys)])
    choice = F.col("x.key").isin("phone", "gender")
    options = F.when(F.col("x.key") == "gender", F.array(F.lit("Female"), F.lit("Male"))).otherwise(F.array().cast("array<string>"))
    q = c.select("set_id", "c_custkey", F.explode(asked).alias("x")).select("set_id", (F.col("c_custkey") * 10 + F.col("x.i")).alias("q_id"), "x.key", choice.alias("is_choice"), options.alias("options"))
    return matching.profile_match(q, facts)


@job("document_match", """select c_custkey as q_id, case c_custkey % 3 when 0 then 'resume_' || c_custkey || '.pdf' when 1 then 'scan_' || c_custkey || '.pdf' else 'photo.png' end as file_name, case c_custkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence from customer""")
def document_match(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    q = c.select(F.col("c_custkey").alias("q_id"), F.col("c_custkey").alias("set_id"), F.when(k == 0, "Upload your CV").when(k == 1, "Academic record").otherwise("Anything else").alias("label"))
    file = lambda n, t: F.struct(n.alias("file_name"), t.alias("text"))
    several = F.array(file(F.concat(F.lit("resume_"), "c_custkey", F.lit(".pdf")), F.lit("work")), file(F.concat(F.lit("scan_"), "c_custkey", F.lit(".pdf")), F.lit("Transcript of 2020")))
    files = c.select(F.col("c_custkey").alias("set_id"), F.explode(F.when(k == 2, F.array(file(F.lit("photo.png"), F.lit("")))).otherwise(several)).alias("f")).select("set_id", "f.*")
    return matching.document_match(q, files, rules.document_words(spark))


@job("attachment_plan", """select c_custkey as q_id, case when c_custkey % 3 <> 2 then 'f' || c_custkey || '.pdf' end as file_name, case when c_custkey % 4 = 0 then 'by hand' when c_custkey % 3 = 2 then 'missing' else 'attach' end as plan from customer""")
def attachment_plan(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("q_id", F.col("c_custkey"))
    return matching.attachment_plan(c.select("q_id", F.when(F.col("q_id") % 4 == 0, "manual").otherwise("auto").alias("mode")), c.where("q_id % 3 <> 2").select("q_id", F.concat(F.lit("f"), "q_id", F.lit(".pdf")).alias("file_name")))


@job("upload_accepts", """select p_partkey as id, p_partkey % 5 <> 3 as accepted from part""")
def upload_accepts(spark, sf_dir):
    k = F.col("p_partkey") % 5
    accept = F.when(k == 0, ".PDF, .doc").when(k == 1, "image/*").when(k == 2, "application/pdf").when(k == 3, ".docx,image/*")
    name, mime = F.when(k == 1, "a.JPG").otherwise("a.pdf"), F.when(k == 1, "image/jpeg").otherwise("application/pdf")
    return matching.upload_accepts(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("file_name"), mime.alias("mime"), accept.alias("accept")))


_LINKS = r"(select page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) as label from pages union all select c_custkey, (['Next', 'SUIVANT', 'zurück zur Liste', 'nextdoor', 'Next step please', ''])[1 + c_custkey % 6] from customer)"
_RULES = ", ".join(f"('{lang}', '{kind}', '{w}', {i})" for i, (lang, kind, w) in enumerate((lang, kind, w) for lang, sets in rules.NAV_LABELS.items() for kind, at in (("submit", 2), ("next", 0), ("back", 1)) for w in sets[at]))


@job("nav_label_join", rf"""with l as {_LINKS}, d as (select distinct label, trim(regexp_replace(lower(strip_accents(label)), '\s+', ' ', 'g')) as t from l),
  r as (select *, strip_accents(label) as rule from (values {_RULES}) as v(language, kind, label, ord)),
  m as (select d.label, r.kind, r.language, row_number() over (partition by d.label order by length(rule) desc, ord) as n from d join r on t = rule or starts_with(t, rule || ' '))
  select kind, language, count(*) as n from l left join m on m.label = l.label and n = 1 group by all""")
def nav_label_join(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("label"))
    shown = F.array(*map(F.lit, ["Next", "SUIVANT", "zurück zur Liste", "nextdoor", "Next step please", ""]))
    labels = links.unionByName(read(spark, sf_dir, "customer").select(F.get(shown, (F.col("c_custkey") % 6).cast("int")).alias("label")))
    return matching.nav_label_join(labels, rules.nav_labels(spark)).groupBy("kind", "language").agg(F.count("*").alias("n"))


# Assignment: forms of customers whose fields and answers are built so that the greedy order is known


# Names with one letter changed, and some cut or longer, as the key says
_NOISY = """case p_partkey % 5 when 0 then p_name when 1 then left(p_name, 2) || chr(cast(97 + p_partkey % 23 as int)) || substr(p_name, 4) when 2 then p_name || ' ' || (p_partkey % 7) when 3 then left(p_name, length(p_name) - 2) || ':'
    else chr(cast(97 + p_partkey % 26 as int)) || chr(cast(97 + p_partkey % 11 as int)) || upper(p_name) || '*' end"""


@job("fuzzy_assign", f"""with n as (select p_partkey as id, p_size as block, trim(regexp_replace(lower(trim({_NOISY})), '[*?!.,:;]+$', '')) as l from part),
  p as (select a.block, a.id as a, b.id as b, round(1 - levenshtein(a.l, b.l) / greatest(length(a.l), length(b.l)), 6) as s from n a join n b on a.block = b.block and a.id % 2 = 0 and b.id % 2 = 1),
  g as (select block, list({{'a': a, 'b': b, 's': s}} order by s desc, a, b) as ps from p where s >= 0.55 group by block),
  r as (select block, unnest(list_reduce(ps, lambda done, x: case when len(list_filter(done, lambda d: d.a = x.a or d.b = x.b)) > 0 then done else done || [x] end, [{{'a': cast(-1 as bigint), 'b': cast(-1 as bigint), 's': 0.0::double}}])) as x from g)
  select block, x.a as a, x.b as b, x.s as score from r where x.a >= 0""")
def fuzzy_assign(spark, sf_dir):
    """Parts with even and odd keys paired one to one within a size by the similarity of their noisy names."""
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("block"), F.col("p_partkey").alias("id"), F.expr(_NOISY).alias("label"))
    p = _keep(p)
    return similarity.assign_labels(p.where("id % 2 = 0"), p.where("id % 2 = 1"), matching.LABEL_MATCH, _keep)


@job("identity_match", """select c_custkey as form_id, a.i as a_id, case when a.i = 2 then 2 when a.i = 3 and c_custkey % 2 = 0 then 4 when a.i = 4 then 5 end as q_id,
    case a.i when 2 then 'key' when 3 then case when c_custkey % 2 = 0 then 'label' else 'refused' end else 'similar' end as how from customer, (select unnest([2, 3, 4]) as i) a""")
def identity_match(spark, sf_dir):
    c = spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id")), "form_id")
    q = lambda i, label, key: F.struct(F.lit(i).alias("q_id"), label.alias("label"), F.lit(key).cast("string").alias("identity_key"))
    a = lambda i, label, value, key, lost: F.struct(F.lit(i).alias("a_id"), F.lit(label).alias("label"), F.lit(value).alias("value"), F.lit(key).cast("string").alias("identity_key"), F.lit(lost).alias("invalidated"))
    even = F.col("form_id") % 2 == 0
    fields = F.array(q(1, F.lit("Employer"), "k1"), q(2, F.lit("Employer"), "k2"), q(3, F.when(even, "Hobby").otherwise("Position held"), None), q(4, F.lit("Position held"), None), q(5, F.lit("Date of graduation"), None))
    given = F.array(a(1, "Employer", " ", "k1", False), a(2, "Employer", "Acme", "k2", False), a(3, "Position held", "Clerk", None, True), a(4, "Graduation date of", "2020", None, False))
    pick = lambda x: c.select("form_id", F.explode(x).alias("x")).select("form_id", "x.*")
    given = F.array(a(1, "Employer", " ", "k1", False), a(2, "Employer", "Acme", "k2", False), a(3, "Position held", "Clerk", None, True), a(4, "Date of graduation *", "2020", None, False))
    return matching.identity_match(pick(fields), pick(given), _keep)


@job("attachment_match", """select c_custkey as form_id, 1 as q_id, case when c_custkey % 3 < 2 then 7 end as a_id from customer""")
def attachment_match(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id")), F.col("form_id") % 3
    q = c.select("form_id", F.lit(1).alias("q_id"), F.lit("Upload your transcript:").alias("label"))
    a = c.select("form_id", F.lit(7).alias("a_id"), F.when(k == 0, "upload your transcript").when(k == 1, "Upload your transkript").otherwise("Cover letter").alias("label"))
    return matching.attachment_match(q, a.unionByName(c.select("form_id", F.lit(6).alias("a_id"), F.lit("Passport").alias("label"))))


@job("evidence_gate", """select o_orderkey as answer_id, case o_orderkey % 5 when 1 then 'needs_user_input' when 2 then 'conflicting_sources' when 4 then 'needs_user_input' else 'answered' end as status,
  case when o_orderkey % 5 in (1, 4) then '' else o_orderpriority end as value, case when o_orderkey % 5 = 0 then 'high' else 'low' end as confidence, cast(case o_orderkey % 5 when 0 then 2 when 1 then 0 when 2 then 2 else 1 end as bigint) as files from orders""")
def evidence_gate(spark, sf_dir):
    return matching.evidence_gate(_evidence(spark, sf_dir), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.lit("answered").alias("status"), F.when(F.col("o_orderkey") % 5 == 4, " ").otherwise(F.col("o_orderpriority")).alias("value"), F.lit(None).cast("string").alias("confidence")))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    row = lambda seq, source, value: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(source).alias("source"), value.alias("value"))
    told = (
        F.when(k == 0, F.array(row(1, "cv.pdf", p), row(2, "sheet.docx", F.lower(p)), row(3, "memory", F.lit("other"))))
        .when(k == 1, F.array(row(1, "my memory", p))).when(k == 2, F.array(row(1, "cv.pdf", p), row(2, "b.txt", F.lit("elsewhere")))).otherwise(F.array(row(1, "cv.pdf", p)))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.explode(told).alias("e")).select("answer_id", "e.*")


@job("cited_files", """select o_orderkey as answer_id, cast(case when o_orderkey % 5 in (0, 2) then 2 else 1 end as bigint) as n, case o_orderkey % 5 when 0 then 'cv.pdf,sheet.docx' when 2 then 'b.txt,cv.pdf' else 'cv.pdf' end as files from orders where o_orderkey % 5 <> 1""")
def cited_files(spark, sf_dir):
    return matching.cited_files(_evidence(spark, sf_dir))


@job("compose_validate", """with c as (select conv_id * 1000 + turn as id, trim(coalesce(text, '')) as t, turn % 4 as k from conversations)
  select id, case when k = 1 or t = '' then 'not found' when k = 2 then 'not found' else 'draft' end as outcome, case when k in (1, 2) then '' else t end as draft,
    cast(case when k = 3 and t <> '' and t <> 'other' then 2 else 0 end as bigint) as n_variants, k = 3 and t <> '' as seed_used from c""")
def compose_validate(spark, sf_dir):
    k = F.col("turn") % 4
    rows = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(k == 2, F.concat(F.lit("As an AI "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("draft"),
        F.when(k == 3, F.array(F.trim("text"), F.lit("other"), F.lit("I cannot say"))).alias("drafts"), (k == 1).alias("not_found"), F.lit(True).alias("seed_used"), F.when(k == 3, "seed").alias("seed"),
    )
    out = matching.compose_validate(rows, audits.LEAKED)
    return out.select("id", "outcome", "draft", F.size("variants").cast("long").alias("n_variants"), "seed_used")


# Frames: a page for each customer: a root, and children that are placed in different ways


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    f = lambda i, parent, url, slot, scanned: F.struct(F.lit(i).alias("frame_id"), F.lit(parent).alias("parent_frame_id"), F.lit(url).alias("url"), F.lit(slot).cast("int").alias("self_slot"), F.lit(scanned).alias("scanned"))
    frames = F.array(
        f(0, -1, "https://a.org/", None, True), f(1, 0, "https://a.org/x", 2, True), f(2, 0, "https://v.org/form?id=1#top", None, True), f(3, 0, "https://w.org/p", None, True),
        f(4, 0, "https://moved.org/", None, False), f(5, 4, "https://z.org/", None, True), f(6, 0, "https://u.org/b?x=2", None, True),
    )
    s = lambda parent, i, src, order: F.struct(F.lit(parent).alias("frame_id"), F.lit(i).alias("slot_idx"), F.lit(src).alias("src"), F.lit(order).alias("ord"))
    slots = F.array(s(0, 1, "https://v.org/form?id=1", 10), s(0, 2, "https://q.org/", 20), s(0, 3, "https://w.org/p?a", 30), s(0, 4, "https://w.org/p?b", 40), s(0, 5, "https://u.org/other", 50))
    pick = lambda x: c.select("page_id", F.explode(x).alias("x")).select("page_id", "x.*")
    return pick(frames), pick(slots)


@job("slot_placement", """with m as (select * from (values (0, 'root', null, null), (1, 'frame-element', 2, 20), (2, 'src-match', 1, 10), (3, 'ambiguous', null, null), (4, 'no match', null, null), (5, 'parent silent', null, null), (6, 'src-match', 5, 50)) as v(frame_id, method, slot_idx, ord))
  select c_custkey as page_id, frame_id, method, cast(slot_idx as integer) as slot_idx, cast(ord as integer) as ord from customer, m""")
def slot_placement(spark, sf_dir):
    return forms.slot_placement(*_frames(spark, sf_dir))


@job("nav_frame_rank", """with i as (select user_id as page_id, event_type as frame_id, count(*) as n, count(*) filter (event_id % 3 <> 0) as o from events group by all)
  select page_id, arg_min(frame_id, {'a': -o, 'm': -n, 'f': frame_id}) filter (frame_id <> 'view') as nav_frame, arg_min(frame_id, {'m': -n, 'f': frame_id}) as title_frame from i group by page_id""")
def nav_frame_rank(spark, sf_dir):
    items = events(spark, sf_dir).select(F.col("key").alias("page_id"), F.col("event_type").alias("frame_id"), (F.col("event_id") % 3 == 0).alias("manual_only"))
    return forms.nav_frame_rank(items.select("page_id", "frame_id", (F.col("frame_id") != "view").alias("has_next")).distinct(), items)


@job("inaccessible_reasons", """with e as (select event_id as page_id, event_id % 6 as k from events)
  select page_id, case k when 1 then 'sandboxed-without-allow-scripts' when 2 then 'load-error' when 3 then 'no-host-access' when 4 then 'scan-timeout' else 'no-content-script' end as reason, k <> 1 as retryable from e where k > 0""")
def inaccessible_reasons(spark, sf_dir):
    k = F.col("event_id") % 6
    frames = events(spark, sf_dir).select(
        F.col("event_id").alias("page_id"), F.lit(1).alias("frame_id"), F.when(k == 1, "allow-forms").when(k == 2, "Allow-Scripts allow-forms").alias("sandbox"), (k == 2).alias("error_occurred"),
        F.when(k == 3, False).when(k == 4, True).alias("granted"), (k == 4).alias("timed_out"),
    )
    return forms.inaccessible_reasons(frames, frames.where("page_id % 6 = 0")).select("page_id", "reason", "retryable")


@job("report_rows", """with c as (select conv_id as form_id, turn % 2 as section, turn as q_idx, trim(coalesce(text, '')) as t, turn % 5 as k from conversations)
  select form_id, section, q_idx, case k when 0 then 'conflict' when 1 then 'from-profile' when 2 then 'suggested' else case when t <> '' then 'answered' else 'suggested' end end as status,
    case when k = 0 then '' when k = 2 then 'hint' when k = 1 then t else case when t <> '' then t else 'hint' end end as text, row_number() over (partition by form_id order by section, q_idx) as place from c""")
def report_rows(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "form_id", "turn": "q_idx"})
    k = F.col("q_idx") % 5
    q = c.select("form_id", (F.col("q_idx") % 2).alias("section"), "q_idx", F.when(k == 0, "conflict").when(k == 1, "from profile").when(k == 2, "draft").otherwise("open").alias("state"))
    return forms.report_rows(q, c.select("form_id", "q_idx", F.col("text").alias("value")), c.select("form_id", "q_idx", F.lit(" hint ").alias("value")))


@job("quota_window_class", """with e as (select event_id as id, event_id % 6 as k, cast(floor(value) as bigint) as v from events where event_type = 'error')
  select id, case when k in (1, 2, 4) or (k = 3 and v * 1000 not between 1 and 120000) then case when k = 1 then 'daily' when k = 2 then 'per_minute' when k = 4 then 'daily' else 'daily' end when k = 3 then 'per_minute' else 'per_minute' end as "window",
    case when k = 1 and v > 0 then v end as observed_limit from e""")
def quota_window_class(spark, sf_dir):
    e, k, v = events(spark, sf_dir).where("event_type = 'error'"), F.col("event_id") % 6, F.floor("value")
    body = (
        F.when(k == 1, F.concat(F.lit('{"violations":[{"quotaValue":"x"},{"quotaId":"RequestsPerDay-FreeTier","quotaValue":"'), v.cast("string"), F.lit('"}]}'))).when(k == 2, '{"violations":[{"quotaId":"GenerateRequestsPerMinute-FreeTier"}]}')
        .when(k == 3, "free_tier limit").when(k == 4, "free tier").when(k == 5, "slow down")
    )
    return ledgers.quota_window_class(e.select(F.col("event_id").alias("id"), body.alias("body"), F.when(k == 3, v * 1000).alias("retry_ms")))


# Nine questions for each customer, whose facts, dossiers, answers and files follow the customer's number


@job("resolve_questions", """with c as (select c_custkey as k, c_mktsegment as m, 'Town of ' || c_mktsegment as town from customer),
  r as (select k, 0 as q, 'facts' as tier, case when k % 4 < 3 then 'from documents' end as state, town as answer, 'cv.pdf' as source, ['x'] as refused from c where k % 4 < 3
    union all select k, 0, 'retry', 'error', null, null, ['facts: no fact', 'declaration: none', 'supplied: no answer'] from c where k % 4 = 3
    union all select k, 1, 'facts', case k % 3 when 0 then 'from documents' else 'needs input' end, case k % 3 when 0 then 'Male' end, case k % 3 when 0 then 'cv.pdf' end, ['x'] from c
    union all select k, 2, 'declaration', 'draft', 'Yes', null, ['facts: no key'] from c union all select k, 3, 'declaration', 'needs input', null, null, ['facts: no key'] from c
    union all select k, 4, 'manual', 'manual only', null, null, [] from c union all select k, 5, 'file', case when k % 2 = 0 then 'file matched' else 'needs input' end, case when k % 2 = 0 then k || '.pdf' end, null, [] from c
    union all select k, 6, case when k % 5 = 4 then 'retry' else 'supplied' end, case k % 5 when 0 then 'from documents' when 1 then 'conflict' when 4 then 'error' else 'needs input' end, case k % 5 when 0 then m end, case k % 5 when 0 then 'a.pdf,b.pdf' end,
      case when k % 5 = 4 then ['facts: no key', 'declaration: none', 'supplied: no answer'] else ['facts: no key', 'declaration: none'] end from c
    union all select k, 7, 'grid', 'needs input', null, null, [] from c
    union all select k, 8, 'facts', case when k % 4 = 2 then 'conflict' else 'from documents' end, case k % 4 when 0 then m when 1 then m || ' Holdings' when 3 then m end, case k % 4 when 0 then 'form.txt' when 1 then 'sheet.pdf' when 3 then 'form.txt' end, ['x'] from c)
  select k as form_id, q as q_idx, tier, state, answer, source, case when tier = 'facts' then [] else refused end as refused from r""")
def resolve_questions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    row = lambda cols, *rows: c.select(k.alias("k"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("k", *[F.col(f"x.{i}").alias(i) for i in cols.split()])
    ask = lambda i, key, label, kind, manual=False, choice=False: F.struct(F.lit(i).alias("q_idx"), F.lit(key).cast("string").alias("key"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(manual).alias("manual_only"), F.lit(choice).alias("is_choice"), (F.array(F.lit("Male"), F.lit("Female")) if choice else F.array().cast("array<string>")).alias("options"))
    asked = row(
        "q_idx key label kind manual_only is_choice options", ask(0, "city", "City", "short_answer"), ask(1, "gender", "Gender", "dropdown", choice=True), ask(2, None, "I hereby certify that this is true", "short_answer"), ask(3, None, "Any conflict of interest?", "paragraph"),
        ask(4, "name", "Password", "short_answer", manual=True), ask(5, None, "Upload your transcript", "file_upload"), ask(6, None, "Tell us more", "paragraph"), ask(7, None, "Rate us", "multiple_choice_grid"), ask(8, "employer", "Employer", "short_answer"),
    ).withColumn("form_id", F.col("k")).withColumnRenamed("k", "set_id")
    fact = lambda ok, field, value, source, rank: F.when(ok, F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), F.lit("high").alias("confidence"), F.lit(1).alias("seq"), F.lit(rank).alias("rule_rank")))
    known = row(
        "field value source confidence seq rule_rank", fact(k % 4 < 3, "city", F.concat(F.lit("Town of "), m), "cv.pdf", 3), fact(k % 3 == 0, "gender", F.lit("male "), "cv.pdf", 3),
        fact(k % 3 == 1, "gender", F.lit("undisclosed"), "cv.pdf", 3), fact(F.lit(True), "employer", m, "form.txt", 4),
    ).withColumnRenamed("k", "set_id")
    other = F.when(k % 4 == 0, F.lower(m)).when(k % 4 == 1, F.concat(m, F.lit(" Holdings"))).otherwise("Zzz")
    dossier = c.select(k.alias("set_id"), F.lit("employer").alias("key"), other.alias("value"), F.lit("sheet.pdf").alias("source"), F.when(k % 4 == 2, "high").otherwise("low").alias("confidence"))
    defaults = spark.createDataFrame([("certification", "Yes")], "declaration string, value string")
    given = c.where("c_custkey % 5 < 4").select(k.alias("form_id"), F.lit(6).alias("q_idx"), F.lit("answered").alias("status"), F.when(k % 5 == 3, " ").otherwise(m).alias("value"), F.lit("low").alias("confidence"))
    said = lambda source, value, seq: F.struct(source.alias("source"), value.alias("value"), F.lit(seq).cast("long").alias("seq"))
    proof = row("source value seq", said(F.when(k % 5 == 2, "memory").otherwise("a.pdf"), m, 1), said(F.when(k % 5 == 2, "talk").otherwise("b.pdf"), F.when(k % 5 == 1, F.lit("something else")).otherwise(F.lower(m)), 2)).withColumnRenamed("k", "form_id").withColumn("q_idx", F.lit(6))
    files = c.where("c_custkey % 2 = 0").select(k.alias("form_id"), F.lit(5).alias("q_idx"), F.concat(k.cast("string"), F.lit(".pdf")).alias("file_name"), F.lit("high").alias("confidence"))
    return resolution.resolve_questions(asked, known, dossier, defaults, given, proof, files)
