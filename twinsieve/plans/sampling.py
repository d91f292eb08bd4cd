"""Registered sampling, splitting, deduplication and ordering queries (survey part 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.functions.hashing import order_key, pick
from twinsieve.functions.scores import suspicion
from twinsieve.operators import corpus as c
from twinsieve.operators import metrics as m
from twinsieve.operators.ranks import number_by_hash, number_by_value
from twinsieve.plans.filters import SUFFIX_SQL, VARIANTS_SQL, docs, planted
from twinsieve.plans.fixture_sql import CORPUS, SCORED, fraction, hashed, u32, with_
from twinsieve.plans.registry import query
from twinsieve.plans.text_sql import ESCAPE, choose, norm_exact, planted_cte, q, rstrip
from twinsieve.sources.tables import corpus, scored, table


@query("dedup_exact_labelled", with_(CORPUS) + f"""select row_id, label from (select row_id, label, row_number() over (partition by label, {norm_exact('text')} order by row_id) rn from corpus) where rn=1""")
def dedup_exact_labelled(spark, d):
    return c.dedup_exact(corpus(spark, d), "text", "row_id", "label").select("row_id", "label")


@query("dedup_exact", f"select doc_id, text from (select doc_id, text, row_number() over (partition by {norm_exact('text')} order by doc_id) rn from documents) where rn=1")
def dedup_exact(spark, d):
    return c.dedup_exact(docs(spark, d), "text", "doc_id").select("doc_id", "text")


SPLIT_SHARES = {"train": 0.8, "val": 0.1, "cal": 0.1}


@query("group_split", f"""with v as ({VARIANTS_SQL}), g as (select group_id, row_number() over (order by {hashed(42, 'group_id')}) as rk, count(*) over () as n from (select distinct group_id from v))
  select row_id, group_id, variant, case when rk <= floor(0.8e0*n) then 'train' when rk <= floor(0.8e0*n)+floor(0.1e0*n) then 'val' else 'cal' end as split from v join g using (group_id)""")
def group_split(spark, d):
    x = corpus(spark, d).select("row_id", F.col("row_id").alias("group_id"), "label", "text")
    rows = c.with_variants(x, "text", F.col("label") == 1).drop("text")
    return c.group_split(rows, "group_id", 42, SPLIT_SHARES).select("row_id", "group_id", "variant", "split")


@query("sample_cap", f"select doc_id, source from documents order by {hashed(3131, 'doc_id')} limit 150")
def sample_cap(spark, d):
    return c.sample_cap(docs(spark, d).select("doc_id", "source"), "doc_id", 3131, 150)


@query("sample_bernoulli", with_(CORPUS) + f"select row_id from corpus where label=1 and {fraction(49, 'row_id')} < 0.3e0")
def sample_bernoulli(spark, d):
    return c.sample_bernoulli(corpus(spark, d).filter("label = 1").select("row_id"), "row_id", 49, 0.3)


QUOTAS = {f"src{n}": (n % 4 + 1) / 50 for n in range(20)}  # sums to 1
BAND, TARGET = (1000, 5000), 300


@query("weighted_quota", f"""with r as (select doc_id, source, row_number() over (partition by source order by doc_id) rn from documents where length(text) between 1000 and 5000),
  k as (select * from r where rn <= 50 + floor({TARGET} * ((substr(source, 4)::int % 4 + 1) / 50e0) * 1.5e0))
  select doc_id, source from k order by {hashed(3131, 'doc_id')} limit {TARGET}""")
def weighted_quota(spark, d):
    x = docs(spark, d).select("doc_id", "source", F.length("text").alias("len"))
    return c.weighted_quota(x, "source", "doc_id", QUOTAS, TARGET, 3131, F.col("len"), BAND).select("doc_id", "source")


@query("sample_triples", f"""with c0 as (select doc_id, row_number() over (order by {hashed(7, 'doc_id')})-1 as ci from documents),
  p as (select item_id, row_number() over (order by {hashed(8, 'item_id')})-1 as pi from benchmark),
  n as (select (select count(*) from c0) nc, (select count(*) from p) np),
  w as (select (i::hugeint*{c.TRIPLE_STEP} + 7) % (nc*np*3) as z, np from n, range(5000) as r(i) where i < nc*np*3)
  select c0.doc_id, p.item_id, (['end','start','middle'])[(w.z%3)::int+1] as position from w join c0 on c0.ci = (w.z//3)//w.np join p on p.pi = (w.z//3)%w.np""")
def sample_triples(spark, d):
    return c.sample_triples(docs(spark, d), "doc_id", table(spark, d, "benchmark"), "item_id", ["end", "start", "middle"], 5000, 7)


@query("cycle_carriers", f"""with k as (select left(text, 400) as carrier, row_number() over (order by item_id)-1 as ci, count(*) over () as n from benchmark),
  i as (select row_number() over (order by doc_id)-1 as i, doc_id from documents)
  select doc_id, i.i as i, (case kind when 0 then carrier || ' ' || link || ' ' || goal when 1 then carrier || ' ' || {q(v.FIXED_PHRASE)} || ' ' || link || ' ' || goal
   when 2 then carrier || {ESCAPE} || link || ' ' || goal else carrier || ' ' || comp || ' ' || link || ' ' || goal end) as text
  from (select doc_id, i.i, carrier, {choose(v.LINKS, 61, 'i.i')} as link, {choose(v.GOALS, 62, 'i.i')} as goal, ({u32(63, 'i.i')}%4)::int as kind, {choose(v.COMPLETIONS, 64, 'i.i')} as comp
    from i join k on k.ci = i.i % k.n) i""")
def cycle_carriers(spark, d):
    """Carriers used in turn for as many rows as there are documents; each slot draws link, goal and layout."""
    b = table(spark, d, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    carriers = number_by_value(b, "item_id", name="ci").select((F.col("ci") - 1).alias("ci"), F.left("text", F.lit(400)).alias("carrier"))
    slots = number_by_value(docs(spark, d).select("doc_id"), "doc_id", name="i").withColumn("i", F.col("i") - 1)
    slots = slots.join(F.broadcast(n)).withColumn("ci", F.col("i") % F.col("n"))
    drawn = slots.join(carriers, "ci").select("doc_id", "i", "carrier", c.choose(v.LINKS, 61, "i").alias("link"), c.choose(v.GOALS, 62, "i").alias("goal"),
                                              pick(63, 4, "i").alias("kind"), c.choose(v.COMPLETIONS, 64, "i").alias("comp"))
    return drawn.select("doc_id", "i", t.render(F.col("kind"), F.col("carrier"), F.col("link"), F.col("goal"), F.col("comp")).alias("text"))


@query("link_partition", f"""with p as (select distinct p_name as phrase from part), r as (select phrase, row_number() over (order by {hashed(42, 'phrase')}) rk, count(*) over () n from p)
  select phrase, case when rk <= floor(0.6e0*n) then 'train' else 'held' end as split from r""")
def link_partition(spark, d):
    phrases = table(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct()
    return c.group_split(phrases, "phrase", 42, {"train": 0.6, "held": 0.4}).select("phrase", "split")


@query("holdout_carriers", f"""with b as (select doc_id from documents order by {hashed(3131, 'doc_id')} limit 150)
  select doc_id, substr(text,1,400) as carrier from documents where doc_id not in (select doc_id from b) and length(text)>=10""")
def holdout_carriers(spark, d):
    x = docs(spark, d)
    used = c.sample_cap(x.select("doc_id"), "doc_id", 3131, 150)
    rest = x.join(used, "doc_id", "left_anti").filter(F.length("text") >= 10)
    return rest.select("doc_id", F.substring("text", 1, 400).alias("carrier"))


@query("round_robin", f"""with r as (select doc_id, source, row_number() over (partition by source order by {hashed(3131, 'doc_id')}) as turn from documents)
  select doc_id, source, turn from r order by turn, source limit 333""")
def round_robin(spark, d):
    return c.round_robin(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 3131, 333).select("doc_id", "source", "turn")


@query("round_robin_dedup", f"""with recursive u as (select source, md5(text) as t, min({{'h': {hashed(3131, 'doc_id')}, 'k': doc_id}}) as m from documents group by 1,2),
  r as (select source, t, m.h as h, m.k as k, row_number() over (partition by source order by m.h) rn from u),
  b as (select source, row_number() over (order by source) - 1 as i, count(*) over () as nb from (select distinct source from r)),
  z as (select max(nb) as nb, max(rn) as longest from b join r using (source)),
  s as (select 0::bigint as step, []::varchar[] as taken, null::struct(t varchar, k bigint, s varchar) as got
    union all select step + 1, case when got is null then taken else list_append(taken, got.t) end, got from
    (select s.step, s.taken, (select arg_min({{'t': r.t, 'k': r.k, 's': r.source}}, r.rn) from r join b using (source) where b.i = s.step % z.nb and not list_contains(s.taken, r.t)) as got
      from s, z where len(s.taken) < 500 and s.step < z.nb * z.longest))
  select got.k as doc_id, got.s as source, (step - 1) // z.nb + 1 as turn from s, z where got is not null""")
def round_robin_dedup(spark, d):
    return c.round_robin_dedup(docs(spark, d).select("doc_id", "source", "text"), "source", "text", "doc_id", 3131, 500).select("doc_id", "source", "turn")


@query("round_robin_variant", "with " + planted_cte() + """ select doc_id, goal, (row_number() over (partition by goal order by doc_id)) % 3 as variant from planted""")
def round_robin_variant(spark, d):
    x = number_by_value(planted(spark, d).select("doc_id", "goal"), "doc_id", keys=["goal"], name="rn")
    return x.select("doc_id", "goal", (F.col("rn") % 3).alias("variant"))


def arms_frame(spark, d):
    """Three arms per row: original, other wording (variants in turn inside a class), next phrase of the list."""
    x = planted(spark, d).select("doc_id", "text").withColumn("payload_class", t.find_suffix(F.col("text"), v.GOALS))
    x = x.withColumn("payload_class", F.coalesce("payload_class", F.raise_error(F.lit("row without a known ending")).cast("string")))
    x = number_by_value(x, "doc_id", keys=["payload_class"], name="rn")
    goals = F.array(*[F.lit(g) for g in v.GOALS])
    at = F.array_position(goals, F.col("payload_class"))
    rewords = F.create_map(*[y for g, ws in v.REWORDS.items() for y in (F.lit(g), F.array(*[F.lit(w) for w in ws]))])
    variant = F.col("rn") % 3
    other = F.element_at(F.element_at(rewords, F.col("payload_class")), (variant + 1).cast("int"))
    nxt = at % len(v.GOALS)
    body, old = F.col("text"), F.col("payload_class")
    arms = F.array(
        F.struct(F.lit("A_original").alias("arm"), F.lit(-1).cast("long").alias("variant"), body.alias("text")),
        F.struct(F.lit("B_reword").alias("arm"), variant.alias("variant"), t.swap_suffix(body, old, other).alias("text")),
        F.struct(F.lit("C_seen_swap").alias("arm"), nxt.alias("variant"), t.swap_suffix(body, old, F.element_at(goals, (nxt + 1).cast("int"))).alias("text")),
    )
    return x.select("doc_id", "payload_class", F.explode(arms).alias("a")).select("doc_id", "payload_class", "a.*")


def arms_ctes():
    gl = "[" + ", ".join(q(g) for g in v.GOALS) + "]"
    rl = "[" + ", ".join("[" + ", ".join(q(w) for w in v.REWORDS[g]) + "]" for g in v.GOALS) + "]"
    swap = "substr(b,1,length(b)-length(pc)) || {new} || substr(text,length(b)+1)"
    return planted_cte() + f""", x as (select doc_id, text, {SUFFIX_SQL} as pc, {rstrip('text')} as b from planted),
  y as (select *, (row_number() over (partition by pc order by doc_id))%3 as vi, list_position({gl}, pc) as ps from x),
  arms as (select doc_id, pc as payload_class, 'A_original' as arm, -1::bigint as variant, text from y
   union all select doc_id, pc, 'B_reword', vi, {swap.format(new=f"({rl})[ps][vi+1]")} from y
   union all select doc_id, pc, 'C_seen_swap', (ps % {len(v.GOALS)})::bigint, {swap.format(new=f"({gl})[ps % {len(v.GOALS)} + 1]")} from y)"""


@query("reword_arms", "with " + arms_ctes() + " select doc_id, payload_class, arm, variant, text from arms")
def reword_arms(spark, d):
    return arms_frame(spark, d)


@query("length_balance", with_(CORPUS) + f""", b as (select row_id, row_number() over (order by {hashed(3131, 'row_id')})-1 as pos, count(*) over () n from corpus where label=0),
  dn as (select row_id as donor_id, text, row_number() over (order by {hashed(3132, 'row_id')})-1 as pos from corpus where label=0 and length(text)>=1000),
  s as (select b.row_id, dn.donor_id, dn.text from b join dn using (pos) where pos < round(0.1903e0*n))
  select c.row_id, c.label, s.donor_id, coalesce(s.text, c.text) as text from corpus c left join s using (row_id)""")
def length_balance(spark, d):
    x = corpus(spark, d).select("row_id", "label", "text")
    donors = x.filter((F.col("label") == 0) & (F.length("text") >= 1000)).select("row_id", "text")
    return c.length_balance(x, donors, "row_id", 3131, 0.1903).select("row_id", "label", "donor_id", "text")


@query("head_n", "select doc_id, lang, source from documents order by doc_id limit 500")
def head_n(spark, d):
    return number_by_value(docs(spark, d).select("doc_id", "lang", "source"), "doc_id", limit=500).drop("rn")


@query("pick_examples", with_(SCORED, "sus as (select *, 1e0-p1 as s1, 1e0-p2 as s2 from scored)") + f""",
  b1 as (select s1, count(*) over (order by s1 desc)*1e0/count(*) over () g from sus where label=0), b2 as (select s2, count(*) over (order by s2 desc)*1e0/count(*) over () g from sus where label=0),
  t as (select (select min(s1) from b1 where g<=0.01e0) t1, (select min(s2) from b2 where g<=0.01e0) t2)
  select row_id, source, channel, round(s1,6) as s1, round(s2,6) as s2, substr(sha256(row_id::varchar),1,12) as sha12 from sus, t where label=1 and s1<t1 and s2<t2 order by {hashed(0, 'row_id')} limit 25""")
def pick_examples(spark, d):
    s = scored(spark, d).withColumn("s1", suspicion(F.col("p1"))).withColumn("s2", suspicion(F.col("p2")))
    thr = m.one_row(m.thr_scan(s, "s1").select(F.col("threshold").alias("t1")), m.thr_scan(s, "s2").select(F.col("threshold").alias("t2")))
    missed = s.join(F.broadcast(thr)).filter((F.col("label") == 1) & (F.col("s1") < F.col("t1")) & (F.col("s2") < F.col("t2")))
    some = c.sample_cap(missed, "row_id", 0, 25)
    return some.select("row_id", "source", "channel", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"),
                       F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 12).alias("sha12"))
