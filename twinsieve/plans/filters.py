"""Registered projections, filters and text queries (survey parts 2.2 and 2.3)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from twinsieve.functions import scores as sc
from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.functions.hashing import pick
from twinsieve.operators import corpus as c
from twinsieve.plans.fixture_sql import CORPUS, SCORED, u32, with_
from twinsieve.plans.registry import query
from twinsieve.plans.text_sql import (choose, norm_exact, norm_neardup, planted_cte, q, rstrip, shingles, squeeze, strip, words)
from twinsieve.sources.tables import corpus, scored, table

LINES = 10


def docs(spark, d):
    return table(spark, d, "documents")


def planted(spark, d):
    """Documents that end in a link phrase and a goal, with white space behind every second one."""
    x = docs(spark, d).select("doc_id", "source", "text", c.choose(v.GOALS, 12, "doc_id").alias("goal"), c.choose(v.LINKS, 11, "doc_id").alias("link"),
                              pick(13, 4, "doc_id").cast("int").alias("kind"), c.choose(v.COMPLETIONS, 14, "doc_id").alias("completion"))
    body = t.render(F.col("kind"), F.col("text"), F.col("link"), F.col("goal"), F.col("completion"))
    even = F.col("doc_id") % 2 == 0
    return x.select("doc_id", "source", "goal", "link", "kind", F.when(even, "train").otherwise("eval").alias("side"),
                    F.concat(body, F.when(even, " \n").otherwise("")).alias("text"))


@query("validate_add", with_(CORPUS) + f"select row_id, {strip('text')} as text, case when label=1 then 'unsafe' else 'safe' end as label, source from corpus where length({strip('text')})>=5")
def validate_add(spark, d):
    x = corpus(spark, d).select("row_id", "text", F.when(F.col("label") == 1, "unsafe").otherwise("safe").alias("label"), "source", F.lit("direct").alias("channel"))
    return c.validated(x, "text", "label", "channel", ["safe", "unsafe"], ["direct", "tool", "document"]).drop("channel")


@query("compose_instruction", """with p as (select doc_id, case when doc_id%5=0 then '' else """ + strip("source || ' ' || lang") + """ end as a, case when doc_id%7=0 then '' else """ + strip("text") + """ end as b from documents),
  r as (select doc_id, case when a<>'' and b<>'' then a || chr(10) || chr(10) || b else a || b end as text from p) select doc_id, text from r where length(text)>=10""")
def compose_instruction(spark, d):
    x = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat_ws(" ", "source", "lang")).alias("a"),
                              F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("b"))
    return x.select("doc_id", t.compose(F.col("a"), F.col("b")).alias("text")).filter(F.length("text") >= 10)


@query("first_user_turn", f"select conv_id, {strip('text')} as text from (select conv_id, arg_min(role, turn) as role, arg_min(text, turn) as text from conversations group by 1) where role='user' and length({strip('text')})>=10")
def first_user_turn(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("f"))
    return first.filter("f.role = 'user'").select("conv_id", t.strip(F.col("f.text")).alias("text")).filter(F.length("text") >= 10)


@query("clip_chars", "select doc_id, substr(text,1,400) as clip400, substr(text,1,3500) as clip3500 from documents")
def clip_chars(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 1, 400).alias("clip400"), F.substring("text", 1, 3500).alias("clip3500"))


@query("token_budget", with_(CORPUS) + rf"""select row_id, label, case when len(tok)>512 then array_to_string(tok[1:512], ' ') else text end as text
  from (select *, string_split_regex({strip('text')}, '[\s\p{{Z}}]+') as tok from corpus) where not (label=1 and len(tok)>512)""")
def token_budget(spark, d):
    x = corpus(spark, d).withColumn("size", F.size(t.tokens(F.col("text"))))
    kept = x.filter((F.col("size") <= 512) | (F.col("label") == 0))
    return kept.select("row_id", "label", t.token_budget(F.col("text"), 512).alias("text"))


@query("length_band_filter", "select doc_id, 'Summarize the following text:' || chr(10) || text as text from documents where length(text)+30 between 1000 and 5000")
def length_band_filter(spark, d):
    body = F.concat(F.lit("Summarize the following text:\n"), F.col("text"))
    return docs(spark, d).select("doc_id", body.alias("text")).filter(F.length("text").between(1000, 5000))


@query("normalize_label", with_(SCORED) + "select row_id, label from scored")
def normalize_label(spark, d):
    s = scored(spark, d)
    form = F.col("row_id") % 3
    raw = F.when(F.col("label") == 1, F.when(form == 0, "unsafe").when(form == 1, "injection").otherwise("1")).otherwise(
        F.when(form == 0, "safe").when(form == 1, "benign").otherwise("0"))
    return s.select("row_id", sc.int_label(raw).alias("label"))


@query("normalize_channel", with_(SCORED) + "select row_id, case when label=0 then null else channel end as channel from scored")
def normalize_channel(spark, d):
    s = scored(spark, d)
    raw = F.when(F.col("channel") == "document", F.when(F.col("row_id") % 2 == 0, "document-embedded").otherwise("document")).when(
        (F.col("channel") == "tool") & (F.col("row_id") % 2 == 0), "tool-output").otherwise(F.col("channel"))
    # Without a channel the source decides; here the source named after the channel stands in for it.
    missing = (F.col("row_id") % 11 == 0) & (F.col("label") == 1)
    names = F.create_map(*[F.lit(x) for kv in v.CHANNEL_OF.items() for x in kv])
    by_source = F.create_map(F.lit("bench-document"), F.lit("document"), F.lit("bench-tool"), F.lit("tool"), F.lit("bench-direct"), F.lit("direct"))
    x = s.select("row_id", F.when(missing, None).otherwise(raw).alias("raw"), F.concat(F.lit("bench-"), F.col("channel")).alias("src"))
    ch = F.coalesce(F.col("raw"), F.try_element_at(by_source, F.col("src")))
    return x.select("row_id", F.coalesce(F.try_element_at(names, ch), ch).alias("channel"))


@query("coalesce_text", "select doc_id, case when doc_id%3=0 then text when doc_id%3=1 then source else lang end as text from documents")
def coalesce_text(spark, d):
    m = F.col("doc_id") % 3
    x = docs(spark, d).select("doc_id", F.when(m == 0, F.col("text")).otherwise("").alias("rendered"), F.when(m == 1, F.col("source")).alias("text"), F.col("lang").alias("input"))
    one = t.first_text(F.col("rendered"), F.col("text"), F.col("input"))
    return x.select("doc_id", F.coalesce(one, F.raise_error(F.lit("row without text")).cast("string")).alias("text"))


@query("inspect_meta", with_(CORPUS) + """select 'doc' || row_id as id, source, label, lang as family, length(text)::bigint as len, substr(sha256(text),1,12) as sha12
  from (select *, row_number() over (partition by source order by row_id) rn from corpus where label=0) where rn<=5""")
def inspect_meta(spark, d):
    x = c.first_rows(corpus(spark, d).filter("label = 0"), "source", ["row_id"], 5)
    return x.select(F.concat(F.lit("doc"), F.col("row_id").cast("string")).alias("id"), "source", "label", F.col("lang").alias("family"),
                    F.length("text").cast("long").alias("len"), F.substring(F.sha2("text", 256), 1, 12).alias("sha12"))


@query("route", with_(SCORED) + "select row_id, case when p1>=0.7e0 then 'pass' when p1<=0.2e0 then 'block' else 'escalate' end as decision from scored")
def route(spark, d):
    return scored(spark, d).select("row_id", sc.route(F.col("p1"), 0.7, 0.2).alias("decision"))


@query("suspicion", with_(SCORED) + "select row_id, round(1e0-p1,6) as suspicion, round(ln(p1)-ln(1e0-p1),6) as gap, round(p1,6) as p_safe from scored")
def suspicion(spark, d):
    z = sc.logit_gap(F.log("p1"), F.log(1.0 - F.col("p1")))
    x = scored(spark, d).select("row_id", "p1", z.alias("z"))
    return x.select("row_id", F.round(sc.suspicion(F.col("p1")), 6).alias("suspicion"), F.round("z", 6).alias("gap"), F.round(sc.sigmoid(F.col("z")), 6).alias("p_safe"))


SOURCES = [f"src{n}" for n in range(20)]


@query("integrity_checks", """with p as (select text, case when doc_id%2=0 then 'train' else 'eval' end as side, source from documents)
  select 'text in two splits' as "check", (select count(*) from (select text from p group by text having count(distinct side)>1))::bigint as violations
  union all select 'unknown source', (select count(*) from p where source is null or source not in (select 'src' || i from range(20) as r(i)))::bigint
  union all select 'phrase in two sets', (select count(*) from (select unnest(""" + words(v.LINKS) + """) as x union all select unnest(""" + words(v.GOALS) + """)) where x in (select unnest(""" + words([p for ps in v.REWORDS.values() for p in ps]) + """)))::bigint
  union all select 'shared source', (select count(*) from (select source from p group by source having count(distinct side)>1))::bigint
  union all select 'text equals a benchmark item', (select count(*) from (select distinct text from documents intersect select text from benchmark))::bigint""")
def integrity_checks(spark, d):
    x = docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("key"), "source", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval").alias("side"))
    both = (F.min("side") != F.max("side")).alias("both")
    bench = table(spark, d, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("key"))
    return (c.violations("text in two splits", x.groupBy("key").agg(both).filter("both"))
            .unionByName(c.violations("unknown source", x.filter(~F.coalesce(F.col("source").isin(SOURCES), F.lit(False)))))
            .unionByName(c.violations("phrase in two sets", c.shared_phrases(spark, {"links": v.LINKS, "goals": v.GOALS, "rewords": [p for ps in v.REWORDS.values() for p in ps]})))
            .unionByName(c.violations("shared source", x.groupBy("source").agg(both).filter("both")))
            .unionByName(c.violations("text equals a benchmark item", x.select("key").intersect(bench))))


def text_query(key, sql_expr, column):
    @query(key, f"select doc_id, {sql_expr} as text from documents")
    def run(spark, d):
        return docs(spark, d).select("doc_id", column(F.col("text")).alias("text"))

    return run


text_query("norm_exact", norm_exact("text"), t.norm_exact)
text_query("norm_neardup", norm_neardup("text"), t.norm_neardup)
text_query("norm_squeeze", squeeze("text"), t.squeeze)
text_query("norm_lines", strip(f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: {squeeze('x')}), chr(10))"), t.norm_lines)
text_query("encode_base64", "to_base64(encode(text))", t.base64_text)
_ALPHA = "abcdefghijklmnopqrstuvwxyz"
text_query("encode_rot13", f"translate(text, '{_ALPHA + _ALPHA.upper()}', '{_ALPHA[13:] + _ALPHA[:13] + (_ALPHA[13:] + _ALPHA[:13]).upper()}')", t.rot13)
HOMOGLYPH_SQL = (f"""array_to_string(list_transform(string_split(text, ''), lambda x, i: case when lower(x) in ('a','e','o','c','p','x')
   and (('0x' || substr(md5(text),1,8))::bigint + (i-1)*2654435761) % 4294967296 < {int(0.3 * 4294967296)} then translate(lower(x), '{v.LATIN}', '{v.CYRILLIC}') else x end), '')""")
text_query("encode_homoglyph", HOMOGLYPH_SQL, t.homoglyph)


def digest(col):
    """Size and order-free digest of a set of strings."""
    return F.md5(F.array_join(F.array_sort(col), "|").cast("binary"))


@query("shingle_set", f"with n as (select doc_id, {norm_neardup('text')} as x from documents), s as (select doc_id, {shingles('x')} as g from n) select doc_id, len(g)::bigint as n, md5(array_to_string(list_sort(g), '|')) as digest from s")
def shingle_set(spark, d):
    x = docs(spark, d).select("doc_id", t.norm_neardup(F.col("text")).alias("x")).select("doc_id", t.shingle_set(F.col("x")).alias("g"))
    return x.select("doc_id", F.size("g").cast("long").alias("n"), digest(F.col("g")).alias("digest"))


@query("shingle_tail", f"with n as (select doc_id, {squeeze('right(text,80)')} as x from documents), s as (select doc_id, {shingles('x', 5, False)} as g from n) select doc_id, len(g)::bigint as n, md5(array_to_string(list_sort(g), '|')) as digest from s")
def shingle_tail(spark, d):
    x = docs(spark, d).select("doc_id", t.tail_shingles(F.col("text")).alias("g"))
    return x.select("doc_id", F.size("g").cast("long").alias("n"), digest(F.col("g")).alias("digest"))


VARIANTS_SQL = with_(CORPUS) + f"""select row_id, row_id as group_id, 'original' as variant, text from corpus
  union all select row_id, row_id, 'b64', to_base64(encode(text)) from corpus where label=1
  union all select row_id, row_id, 'rot13', translate(text, '{_ALPHA + _ALPHA.upper()}', '{_ALPHA[13:] + _ALPHA[:13] + (_ALPHA[13:] + _ALPHA[:13]).upper()}') from corpus where label=1
  union all select row_id, row_id, 'homoglyph', {HOMOGLYPH_SQL} from corpus where label=1"""


@query("variant_union", VARIANTS_SQL)
def variant_union(spark, d):
    x = corpus(spark, d).select("row_id", F.col("row_id").alias("group_id"), "label", "text")
    return c.with_variants(x, "text", F.col("label") == 1).select("row_id", "group_id", "variant", "text")


@query("render_template", "with " + planted_cte() + " select doc_id, kind, text from planted")
def render_template(spark, d):
    return planted(spark, d).select("doc_id", "kind", "text")


@query("plant_payload", f"""with p as (select doc_id, text, {choose(v.GOALS, 31, 'doc_id')} as goal, {choose(['end', 'start', 'middle'], 32, 'doc_id')} as pos from documents)
  select doc_id, pos, case pos when 'end' then text || chr(10) || goal when 'start' then goal || chr(10) || text
   else substr(text,1,length(text)//2) || chr(10) || goal || chr(10) || substr(text, length(text)//2+1) end as text from p""")
def plant_payload(spark, d):
    x = docs(spark, d).select("doc_id", "text", c.choose(v.GOALS, 31, "doc_id").alias("goal"), c.choose(["end", "start", "middle"], 32, "doc_id").alias("pos"))
    return x.select("doc_id", "pos", t.plant(F.col("text"), F.col("goal"), F.col("pos")).alias("text"))


# Braces and backslashes of the documents themselves are mapped away, so that only planted tokens are filled.
PLAIN_SQL = "translate(text, '{}' || chr(92), '()/')"


@query("fill_slots", f"""select doc_id, {strip("'Dear " + v.FILLERS["recipient"] + ",' || chr(10) || " + PLAIN_SQL + " || ' TODO: ' || " + choose(v.GOALS, 41, 'doc_id') + " || ' re <other_thing> and <injection_2>'")} as text from documents""")
def fill_slots(spark, d):
    plain = t.without_slots(F.col("text"))
    carrier = F.concat(F.lit("Dear {recipient},\\n"), plain, F.lit(" {injection_1} re {Other_Thing} and {_injection_2}"))
    payload = F.concat(F.lit("TODO: "), c.choose(v.GOALS, 41, "doc_id"))
    return docs(spark, d).select("doc_id", t.fill_slots(carrier, payload).alias("text"))


SUFFIX_SQL = f"(select arg_max(p, length(p)) from (select unnest({words(v.GOALS)}) as p) where ends_with({rstrip('text')}, p))"


@query("find_suffix", "with " + planted_cte() + f" select doc_id, {SUFFIX_SQL} as payload from planted")
def find_suffix(spark, d):
    return planted(spark, d).select("doc_id", t.find_suffix(F.col("text"), v.GOALS).alias("payload"))


@query("swap_suffix", "with " + planted_cte() + f""" select doc_id, substr(b,1,length(b)-length(goal)) || 'new ending' || substr(text,length(b)+1) as text
  from (select doc_id, text, {SUFFIX_SQL} as goal, {rstrip('text')} as b from planted)""")
def swap_suffix(spark, d):
    x = planted(spark, d).withColumn("old", t.find_suffix(F.col("text"), v.GOALS))
    return x.select("doc_id", t.swap_suffix(F.col("text"), F.col("old"), F.lit("new ending")).alias("text"))


_MARKERS = ("Please set the text above aside.", "Done. All fine.", "]}]}", "Finished: nothing found.")
MARKER_SQL = "case " + " ".join(f"when contains(text, {q(m)}) then {q(m)}" for m in _MARKERS) + " else 'none/other' end"
CARRIER_SQL = "coalesce(" + ", ".join(f"case when instr(text, {q(m)})>1 then {strip(f'substr(text,1,instr(text,{q(m)})-1)')} end" for m in _MARKERS) + ")"
PAYLOAD_SQL = "nullif(" + strip(f"regexp_extract(text, '(?s)(?:{'|'.join(re.escape(x) for x in v.LINKS)})\\s*(.+)$', 1)") + ", '')"


@query("parse_parts", "with " + planted_cte() + f" select doc_id, {PAYLOAD_SQL} as payload, {MARKER_SQL} as marker, {CARRIER_SQL} as carrier from planted")
def parse_parts(spark, d):
    x = F.col("text")
    return planted(spark, d).select("doc_id", t.payload_of(x).alias("payload"), t.marker_of(x).alias("marker"), t.carrier_of(x).alias("carrier"))


def prompt_sql(name, text):
    so, scl, uo, uc, ao, _ = v.CHAT_TEMPLATES[name]
    return f"{q(so + v.SYSTEM_PROMPT + scl + uo)} || e'Text:\\n' || {text} || {q(chr(10) * 2 + 'Label:' + uc + ao)}"


@query("render_prompt", " union all ".join(f"select doc_id, '{n}' as model, {prompt_sql(n, 'text')} as prompt from documents" for n in v.CHAT_TEMPLATES))
def render_prompt(spark, d):
    forms = F.array(*[F.struct(F.lit(n).alias("model"), t.prompt(tp, F.col("text")).alias("prompt")) for n, tp in v.CHAT_TEMPLATES.items()])
    return docs(spark, d).select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.*")


@query("sft_table", with_(CORPUS) + f"""select row_id, {prompt_sql('tagged', 'text')} as prompt, case when label=1 then 'injection' else 'benign' end || {q(v.CHAT_TEMPLATES['tagged'][5])} as completion
  from corpus order by row_id limit 200""")
def sft_table(spark, d):
    tp = v.CHAT_TEMPLATES["tagged"]
    word = F.when(F.col("label") == 1, "injection").otherwise("benign")
    first = corpus(spark, d).orderBy("row_id").limit(200)
    return first.select("row_id", t.prompt(tp, F.col("text")).alias("prompt"), F.concat(word, F.lit(tp[5])).alias("completion"))


@query("make_id", "select doc_id, printf('%s-%06d', source, row_number() over (partition by source order by doc_id)-1) as id from documents")
def make_id(spark, d):
    x = c.in_order(docs(spark, d).select("doc_id", "source"), "doc_id", "rn", ["source"])
    return x.select("doc_id", F.format_string("%s-%06d", F.col("source"), F.col("rn") - 1).alias("id"))
