"""Registered source and sink queries (survey part 2.1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.functions.scores import clean
from twinsieve.operators import corpus as c
from twinsieve.operators import fingerprints as fp
from twinsieve.operators.ranks import quantiles
from twinsieve.plans.fixture_sql import SAMPLES, SCORED, with_
from twinsieve.plans.registry import query
from twinsieve.plans.text_sql import choose, norm_exact, strip
from twinsieve.sources import readers as r
from twinsieve.sources.tables import samples, scored, table

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("src_jsonl", "select doc_id, text, lang, source, n_chars from documents")
def src_jsonl(spark, d):
    path = r.write_jsonl(table(spark, d, "documents"), r.scratch(spark, "jsonl"))
    return r.read_jsonl(spark, path, DOC_SCHEMA)


@query("sink_jsonl", "select source, count(*)::bigint as n, sum(length(text))::bigint as chars, max(md5(text)) as max_md5 from documents group by 1")
def sink_jsonl(spark, d):
    path = r.write_jsonl(table(spark, d, "documents"), r.scratch(spark, "sink"))
    back = r.read_jsonl(spark, path, DOC_SCHEMA)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"),
                                      F.max(F.md5(F.col("text").cast("binary"))).alias("max_md5"))


@query("src_scores", with_(SCORED) + """select row_id, round(ln(p1),6) as logp_benign, round(ln(1e0-p1),6) as logp_injection,
  case when n_tokens%97=0 then null else p1 end as p_safe from scored""")
def src_scores(spark, d):
    s = scored(spark, d)
    bad = F.when(F.col("n_tokens") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("p1"))
    rows = s.select("row_id", F.log("p1").alias("logp_benign"), F.log(1.0 - F.col("p1")).alias("logp_injection"), bad.alias("p_safe"))
    back = r.read_scores(spark, r.write_jsonl(rows, r.scratch(spark, "scores")))
    return back.select("row_id", F.round("logp_benign", 6).alias("logp_benign"), F.round("logp_injection", 6).alias("logp_injection"), "p_safe")


@query("src_meta_only", "select doc_id, lang, source, length(text)::bigint as len from documents")
def src_meta_only(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("len"))


@query("src_capped", f"select source, doc_id, rn from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents where length({strip('text')})>=5) where rn<=20")
def src_capped(spark, d):
    ok = table(spark, d, "documents").filter(F.length(t.strip(F.col("text"))) >= 5)
    return c.first_rows(ok, "source", ["doc_id"], 20).select("source", "doc_id", "rn")


@query("src_nested_payloads", f"""select distinct lang as category, payload from (select lang, unnest(string_split(text, chr(10))) as payload from documents) where {strip('payload')}<>''""")
def src_nested_payloads(spark, d):
    docs = table(spark, d, "documents").select(F.to_json(F.create_map("lang", F.split("text", "\n"))).alias("raw"))
    lists = docs.select(F.explode(F.from_json("raw", "map<string,array<string>>")).alias("category", "items"))
    return lists.select("category", F.explode("items").alias("payload")).filter(t.strip(F.col("payload")) != "").distinct()


@query("src_contexts", f"select doc_id, {strip('text')} as context, lang as question from documents where {strip('text')}<>''")
def src_contexts(spark, d):
    docs = table(spark, d, "documents")
    as_list = F.to_json(F.struct(F.split("text", "\n").alias("context"), F.col("lang").alias("question")))
    as_text = F.to_json(F.struct(F.col("text").alias("context"), F.col("lang").alias("question")))
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, as_list).otherwise(as_text).alias("raw"))
    out = raw.select("doc_id", t.strip(r.list_or_text(F.col("raw"), "$.context")).alias("context"),
                     F.get_json_object("raw", "$.question").alias("question"))
    return out.filter(F.col("context") != "")


@query("src_tool_cases", f"""with f as (select doc_id, lang as file, case when doc_id%3=0 then '' else text || ' <slot> end' end as enhanced, text || ' <slot>' as base,
  {choose(v.GOALS, 21, 'doc_id')} as instruction from documents)
  select doc_id, file, replace(coalesce(nullif(enhanced,''), base), '<slot>', instruction) as text from f order by file, doc_id limit 300""")
def src_tool_cases(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("file"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("text", F.lit(" <slot> end"))).alias("enhanced"),
        F.concat("text", F.lit(" <slot>")).alias("base"), c.choose(v.GOALS, 21, "doc_id").alias("instruction"))
    text = F.replace(t.first_text(F.col("enhanced"), F.col("base")), F.lit("<slot>"), F.col("instruction"))
    return docs.select("doc_id", "file", text.alias("text")).orderBy("file", "doc_id").limit(300)


@query("src_carriers", """with l as (select source as suite, unnest(string_split(case when doc_id%2=0 then text else replace(text, '. ', '. {injection_' || lang || '} ') end, chr(10))) as carrier from documents)
  select suite, regexp_extract(carrier, '\\{([A-Za-z0-9_]*injection[A-Za-z0-9_]*)\\}', 1) as vector, count(*)::bigint as n, max(md5(carrier)) as top from (select distinct suite, carrier from l)
  where regexp_matches(carrier, '\\{([A-Za-z0-9_]*injection[A-Za-z0-9_]*)\\}') group by 1,2""")
def src_carriers(spark, d):
    docs = table(spark, d, "documents")
    marked = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(
        F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(". {injection_"), F.col("lang"), F.lit("} "))))
    lines = docs.select(F.col("source").alias("suite"), F.explode(F.split(marked, "\n")).alias("carrier"))
    found = lines.filter(F.col("carrier").rlike(t.SLOT)).distinct().withColumn("vector", F.regexp_extract("carrier", t.SLOT, 1))
    return found.groupBy("suite", "vector").agg(F.count(F.lit(1)).alias("n"), F.max(F.md5(F.col("carrier").cast("binary"))).alias("top"))


# Fixed value: how source files assign a goal, in single or triple quotes.
GOAL_PATTERN = r"(?s)GOAL\s*=\s*f?(['\"]{1,3})(.*?)\1"


@query("src_goals", r"""with s as (select page_id%4 as suite, regexp_replace(regexp_replace(regexp_replace(html, '["\']', '', 'g'), '<h1>([^<]*)</h1>', 'GOAL = "\1 for {recipient}"', 'g'),
    '<p>([^<]*)', 'GOAL = f\'\'\'ask  {_title_} about \1  {other}\'\'\'', 'g') as src from pages),
  g as (select suite, unnest(regexp_extract_all(src, 'GOAL\s*=\s*f?["\']{1,3}([^"\']*)["\']{1,3}', 1)) as goal from s)
  select distinct suite, goal from (select suite, trim(regexp_replace(replace(replace(replace(goal,'{recipient}','someone@example.com'),'{_title_}','Weekly meeting'),'{other}','<other>'), '[\s\p{Z}]+', ' ', 'g')) as goal from g)
  where length(goal)>=15 and not contains(goal, '{')""".replace("\\'", "''"))
def src_goals(spark, d):
    """Headings and paragraphs of every page stand as goal assignments in its source text, which is searched as a whole."""
    plain = F.regexp_replace("html", "[\"']", "")
    src = F.regexp_replace(F.regexp_replace(plain, "<h1>([^<]*)</h1>", 'GOAL = "$1 for {recipient}"'), "<p>([^<]*)", "GOAL = f\'\'\'ask  {_title_} about $1  {other}\'\'\'")
    raw = table(spark, d, "pages").select((F.col("page_id") % 4).alias("suite"), F.explode(F.regexp_extract_all(src, F.lit(GOAL_PATTERN), F.lit(2))).alias("goal"))
    goals = raw.select("suite", t.squeeze(t.fill_tokens(F.col("goal"))).alias("goal"))
    return goals.filter((F.length("goal") >= 15) & ~F.contains("goal", F.lit("{"))).distinct()


@query("src_multi_union", "select 'train:' || doc_id as origin, text from documents where text<>'' union all select 'val:' || item_id, text from benchmark where text<>''")
def src_multi_union(spark, d):
    return r.union_splits(spark, {"train": (f"{d}/documents.parquet", "doc_id", "text"), "val": (f"{d}/benchmark.parquet", "item_id", "text"),
                                  "cal": (f"{d}/no_such_split.parquet", "doc_id", "text")})


def curve_points(s, *keys):
    """Median latency of every (keys, model, length) cell."""
    cells = [*keys, "model", "role", "target_tokens", "actual_tokens"]
    return quantiles(s, "ms", {"median_ms": 0.5}, cells)


CURVES_SQL = """curves as (select regime, session, model, role, target_tokens, actual_tokens, quantile_cont(ms,0.5) as median_ms from samples group by all)"""


@query("src_latency_curves", with_(SAMPLES) + """, p as (select regime, model, role, target_tokens, actual_tokens, quantile_cont(ms,0.5) as median_ms from samples group by all)
  select regime, 'profile' as form, model, role, target_tokens, actual_tokens, round(median_ms,6) as ms1, null::double as ms2 from p
  union all select a.regime, 'pair', a.model, a.role, a.target_tokens, a.actual_tokens, round(a.median_ms,6), round(b.median_ms,6) from p a join p b
  on a.regime=b.regime and a.target_tokens=512 and b.target_tokens=512 and a.role='stage1' and b.role='stage2'""")
def src_latency_curves(spark, d):
    # A curve document holds models x lengths points: a bounded group however many samples it came from.
    pts = curve_points(samples(spark, d), "regime")
    by_len = pts.groupBy("regime", "model", "role").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("target_tokens").cast("string"), F.struct("median_ms", F.col("actual_tokens").alias("actual_prompt_tokens"))))).alias("by_length"))
    docs = by_len.groupBy("regime").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("role", "by_length")))).alias("per_model"))
    nested = docs.select("regime", F.to_json(F.struct("per_model")).alias("doc"))
    prof = r.curve_rows(nested, "doc", "regime").select("regime", F.lit("profile").alias("form"), "model", "role", "target_tokens", "actual_tokens",
                                                        F.round("median_ms", 6).alias("ms1"), F.lit(None).cast("double").alias("ms2"))
    at = pts.filter("target_tokens = 512")
    k2 = at.filter("role = 'stage2'").select("regime", F.col("median_ms").alias("k2_ms"))
    k1 = at.filter("role = 'stage1'").select("regime", "model", F.col("median_ms").alias("k1_ms"))
    flat = k1.join(k2, "regime").groupBy("regime").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("k1_ms", "k2_ms")))).alias("cascade_k1k2"))
    pairs = r.pair_rows(flat.select("regime", F.to_json(F.struct("cascade_k1k2")).alias("doc")), "doc", "regime")
    pairs = pairs.select("regime", F.lit("pair").alias("form"), "model", F.lit("stage1").alias("role"), F.lit(512).cast("long").alias("target_tokens"),
                         F.lit(512).cast("long").alias("actual_tokens"), F.round("k1_ms", 6).alias("ms1"), F.round("k2_ms", 6).alias("ms2"))
    return prof.unionByName(pairs)


@query("src_resume", with_(SCORED) + "select row_id as idx, ms, case when split='cal' then 'earlier' else 'new' end as run from scored")
def src_resume(spark, d):
    s = scored(spark, d).select(F.col("row_id").alias("idx"), "ms", "split")
    path = r.scratch(spark, "resume")
    s.filter("split = 'cal'").select("idx", "ms").write.parquet(path)
    earlier = spark.read.parquet(path)
    todo = s.select("idx", "ms").join(earlier, "idx", "left_anti").withColumn("run", F.lit("new"))
    return earlier.withColumn("run", F.lit("earlier")).unionByName(todo)


def _shares_sql(col, tag):
    return f"(select string_agg(k || '=' || n, ';' order by k || '=' || n) from (select coalesce({col}::varchar, 'null') as k, count(*) as n from m group by 1)) as {tag}"


SPLIT_SQL = "case when doc_id%10<8 then 'train' when doc_id%10=8 then 'val' else 'cal' end"
MANIFEST_FACETS = {"by_source": "source", "by_lang": "lang", "by_split": "split", "by_label": "label"}


@query("sink_manifest", f"""with m as (select d.*, {SPLIT_SQL} as split, case when toxic=1 then 'unsafe' when toxic=0 then 'safe' end as label from documents d left join labels using (doc_id))
  select count(*)::bigint as n_total, count(*) filter (length(text)>=1000)::bigint as n_long, max(length(text))::bigint as len_max, sum(length(text))::bigint as chars,
  {', '.join(_shares_sql(col, tag) for tag, col in MANIFEST_FACETS.items())}, 'seed=3131;train=0.8;val=0.1;cal=0.1;long=1000' as parameters from m""")
def sink_manifest(spark, d):
    """One document on the corpus: sizes, distributions, rows per split and the build's parameters."""
    i = F.col("doc_id") % 10
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select(
        F.length("text").cast("long").alias("len"), "source", "lang", F.when(i < 8, "train").when(i == 8, "val").otherwise("cal").alias("split"),
        F.when(F.col("toxic") == 1, "unsafe").when(F.col("toxic") == 0, "safe").alias("label"))
    return c.manifest(rows, "len", MANIFEST_FACETS, {"seed": 3131, "train": 0.8, "val": 0.1, "cal": 0.1, "long": 1000})


DIGESTED = {
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "conversations": ("conv_id", "turn", "role", "text"), "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"),
}


def _digest_sql(name, cols):
    # every field with its length in front, so that no two rows of fields read alike; NULL has none
    row = " || '|' || ".join(f"coalesce(length({x}::varchar) || ':' || {x}::varchar, 'null')" for x in cols)
    return f"select '{name}' as tbl, count(*)::bigint as n, sum(('0x' || substr(md5({row}),1,8))::bigint)::varchar as digest from {name}"


@query("fingerprint", " union all ".join(_digest_sql(n, cs) for n, cs in DIGESTED.items()))
def fingerprint(spark, d):
    """Rows and an order-free digest of all columns of every corpus table."""
    def one(name, cols):
        fields = [F.coalesce(F.concat(F.length(F.col(x).cast("string")).cast("string"), F.lit(":"), F.col(x).cast("string")), F.lit("null")) for x in cols]
        part = F.conv(F.substring(F.md5(F.concat_ws("|", *fields).cast("binary")), 1, 8), 16, 10).cast("long")
        return table(spark, d, name).agg(F.count(F.lit(1)).alias("n"), F.sum(part.cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(name).alias("tbl"), "n", "digest")

    out = None
    for name, cols in DIGESTED.items():
        out = one(name, cols) if out is None else out.unionByName(one(name, cols))
    return out


PINNED = {**DIGESTED, "events": ("event_id", "user_id", "event_type")}


def _lanes_sql(name, cols, rows=None):
    row = " || '|' || ".join(f"coalesce(length({x}::varchar) || ':' || {x}::varchar, 'null')" for x in cols)
    lanes = ", ".join(f"(coalesce(sum(('0x' || substr(sha256({row}),{16 * i + 1},16))::ubigint::hugeint),0) % 18446744073709551616)::varchar as lane{i}" for i in range(4))
    return f"select '{name}' as tbl, count(*)::bigint as n, {lanes} from {rows or name}"


_NOW = {
    "documents": "documents", "events": "events",
    "conversations": "(select * from conversations union all select * from conversations where turn = 0)",
    "pages": "(select page_id, case when page_id%10=3 then url || '#' else url end as url, html from pages)",
    "benchmark": "(select * from benchmark where item_id%4<>0)",
}


@query("fingerprint_compare", with_(
    "now as (" + " union all ".join(_lanes_sql(n, PINNED[n], rows) for n, rows in _NOW.items()) + ")",
    "pin as (" + " union all ".join(_lanes_sql(n, cols) for n, cols in DIGESTED.items()) + ")")
    + """select coalesce(now.tbl, pin.tbl) as tbl, case when now.tbl is null then 'missing' when pin.tbl is null then 'unpinned' when now.n=pin.n and now.lane0=pin.lane0 and now.lane1=pin.lane1
  and now.lane2=pin.lane2 and now.lane3=pin.lane3 then 'same' else 'changed' end as verdict, (coalesce(now.n,0)-coalesce(pin.n,0))::bigint as gained, now.n, now.lane0, now.lane1, now.lane2, now.lane3
  from now full join pin on now.tbl=pin.tbl""")
def fingerprint_compare(spark, d):
    """All corpus tables pinned, then compared after doubled, changed and removed rows; counts follow the differences alone."""
    t = {name: table(spark, d, name) for name in PINNED}
    one = lambda name, rows=None: fp.fingerprint(t[name] if rows is None else rows, name, PINNED[name])
    pinned = r.stored(reduce(DataFrame.unionByName, [one(name) for name in DIGESTED]), "pinned")
    old = lambda name: pinned.filter(F.col("tbl") == name)
    now = [
        fp.updated(one("documents", t["documents"].filter("doc_id % 2 = 0")), added=one("documents", t["documents"].filter("doc_id % 2 <> 0"))),
        fp.updated(old("conversations"), added=one("conversations", t["conversations"].filter("turn = 0"))),
        one("pages", t["pages"].withColumn("url", F.when(F.col("page_id") % 10 == 3, F.concat("url", F.lit("#"))).otherwise(F.col("url")))),
        fp.updated(old("benchmark"), removed=one("benchmark", t["benchmark"].filter("item_id % 4 = 0"))),
        one("events"),
    ]
    now = reduce(DataFrame.unionByName, now)
    return fp.compared(now, pinned).join(now, "tbl", "left")
