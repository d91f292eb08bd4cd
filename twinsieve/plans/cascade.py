"""Registered calibration, routing and cascade queries (survey part 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.functions.scores import injection_nll, ratio, sigmoid, suspicion
from twinsieve.operators import bootstrap as b
from twinsieve.operators import calibrate as cal
from twinsieve.operators import cascade as k
from twinsieve.operators import cellboot
from twinsieve.operators import metrics as m
from twinsieve.operators.ranks import quantiles
from twinsieve.plans.fixture_sql import SAMPLES, SCORED, auroc_sql, dr_ctes, with_
from twinsieve.plans.metrics import GROUPED, SUS, bins_cte, channel_vs_benign, rnd, suspicious
from twinsieve.plans.registry import query
from twinsieve.sources.tables import samples, scored

CHANNELS = ("document", "tool", "direct")
GRID = k.theta_grid(0.0, 1.0, 0.005)
FROZEN = 0.005
LOG_GRID = k.sweep_grid(FROZEN, 40)


def lst(values):
    return "[" + ", ".join(f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in values) + "]"


def point_ctes(src, thetas, fpr="0.01e0", tag="c"):
    """CTE ``{tag}_pt``: the operating point at every theta of a list."""
    return f"""{tag}_g as (select unnest({thetas}) as theta),
 {tag}_n as (select sum(1-label) nb, sum(label) na, count(*) nn from {src}),
 {tag}_esc as (select theta, s2, label from {src} join {tag}_g on p1 < theta),
 {tag}_eb as (select theta, s2, row_number() over (partition by theta order by s2) rn, count(*) over (partition by theta) neb from {tag}_esc where label=0),
 {tag}_t as (select theta, max(s2) as theta2 from {tag}_eb, {tag}_n where rn = ceil((neb-1)*(1e0-least(1e0,{fpr}*nb/neb)))+1 group by 1),
 {tag}_a as (select {tag}_g.theta, coalesce(max({tag}_t.theta2), null) as theta2, count({tag}_esc.label) as ne, coalesce(sum({tag}_esc.label),0) as ea, coalesce(sum(1-{tag}_esc.label),0) as eb,
   coalesce(sum(case when {tag}_esc.label=1 and ({tag}_t.theta2 is null or s2>{tag}_t.theta2) then 1 else 0 end),0) as caught,
   coalesce(sum(case when {tag}_esc.label=0 and s2>{tag}_t.theta2 then 1 else 0 end),0) as fp
   from {tag}_g left join {tag}_t using (theta) left join {tag}_esc on {tag}_esc.theta={tag}_g.theta group by 1),
 {tag}_pt as (select theta, ne*1e0/nn as e, caught*1e0/na as tpr, fp*1e0/nb as fpr, (na-ea)::bigint as passed, caught::bigint as caught, fp::bigint as fp, theta2, eb::bigint as n_esc_benign from {tag}_a, {tag}_n)"""


POINT = "theta, round(e,6) as e, round(tpr,6) as tpr, round(fpr,6) as fpr, passed, caught, fp, theta2, n_esc_benign"
POINT_COLS = ("theta", "e", "tpr", "fpr", "passed", "caught", "fp", "theta2", "n_esc_benign")


def shown(pts):
    return rnd(pts.select(*POINT_COLS), "e", "tpr", "fpr")


@query("join_row_order", with_(SCORED) + "select row_id, label, channel, p1, p2, (select count(*) from scored)::bigint as n_labels from scored")
def join_row_order(spark, d):
    s = scored(spark, d)
    left, right = s.select("row_id", "label", "channel"), s.select("row_id", "p1", "p2")
    both = left.join(right, "row_id")
    sizes = m.one_row(left.agg(F.count(F.lit(1)).alias("a")), right.agg(F.count(F.lit(1)).alias("b")), both.agg(F.count(F.lit(1)).alias("c")))
    same = (F.col("a") == F.col("b")) & (F.col("a") == F.col("c"))
    guard = sizes.select(F.when(same, F.col("a")).otherwise(F.raise_error(F.lit("scores and labels do not line up")).cast("long")).alias("n_labels"))
    return both.join(F.broadcast(guard))


@query("cascade_point", with_(SCORED, SUS, point_ctes("sus", "[0.7e0]")) + f"select {POINT} from c_pt")
def cascade_point(spark, d):
    return shown(k.cascade_at(suspicious(spark, d), 0.7))


@query("cascade_frontier", with_(SCORED, SUS, point_ctes("sus", lst(GRID))) + f"""select {POINT},
  theta = (select arg_max(theta, (round(tpr,9), -e, -theta)) from c_pt where fpr <= 0.01e0+1e-9) as best from c_pt""")
def cascade_frontier(spark, d):
    pts = k.frontier(suspicious(spark, d), GRID)
    best = k.best_point(pts).select(F.col("theta").alias("bt"))
    return rnd(pts.join(F.broadcast(best)).select(*POINT_COLS, (F.col("theta") == F.col("bt")).alias("best")), "e", "tpr", "fpr")


SELECT_SQL = with_(SCORED, SUS, "calr as (select * from sus where split='cal')", "evr as (select * from sus where split='eval')", dr_ctes("calr", "label", "s2", "0.01e0", None, "d"),
                   point_ctes("calr", lst(GRID), tag="c")) + """, pick as (select arg_min(theta, (e, theta)) as th from c_pt, d_res where fpr<=0.01e0+1e-9 and tpr >= 0.99e0*d_res.dr-1e-9)"""


@query("select_theta_on_cal", SELECT_SQL + ", " + point_ctes("evr", "(select [th] from pick)", tag="v") + f" select {POINT} from v_pt")
def select_theta_on_cal(spark, d):
    s = suspicious(spark, d)
    theta = k.select_theta(s.filter("split = 'cal'"), GRID)
    if theta is None:
        raise ValueError("no theta keeps the wanted detection rate on the calibration rows")
    return shown(k.cascade_at(s.filter("split = 'eval'"), theta))


MED512 = """k12 as (select max(case when model='small-a' then m end) as k1, max(case when model='large' then m end) as k2 from (select model, quantile_cont(ms,0.5) as m from samples
  where target_tokens=512 and regime='nf4' group by 1))"""


def k1_k2(spark, d):
    at = samples(spark, d).filter("target_tokens = 512 and regime = 'nf4'")
    med = quantiles(at, "ms", {"m": 0.5}, ["model"])
    return med.agg(F.max(F.when(F.col("model") == "small-a", F.col("m"))).alias("k1"), F.max(F.when(F.col("model") == "large", F.col("m"))).alias("k2"))


@query("theta_sweep", with_(SCORED, SUS, SAMPLES, MED512, point_ctes("sus", lst(LOG_GRID)), "calr as (select * from sus where split='cal')", dr_ctes("calr", "label", "s2", "0.01e0", None, "d"),
                            point_ctes("calr", lst(LOG_GRID), tag="k")) + f""", pick as (select arg_min(theta, (e, theta)) as th from k_pt, d_res where fpr<=0.01e0+1e-9 and tpr >= 0.99e0*d_res.dr-1e-9), ch as (select theta,
   {', '.join(f"round(avg(case when channel='{c}' then case when p1<theta and s2>=theta2 then 1e0 else 0e0 end end),6) as dr_{c}" for c in CHANNELS)}
   from c_pt, sus where label=1 group by 1) select {POINT}, dr_document, dr_tool, dr_direct, round(1e0-(k1+e*k2)/k2,6) as latency_reduction,
   trim(case when theta=0.005e0 then 'FROZEN' else '' end || case when theta=(select th from pick) then ' CAL-SELECTED' else '' end) as note from c_pt join ch using (theta), k12""")
def theta_sweep(spark, d):
    s = suspicious(spark, d)
    pts = k.sweep_by_channel(s, k.frontier(s, LOG_GRID), CHANNELS).join(F.broadcast(k1_k2(spark, d)))
    red = F.lit(1.0) - (F.col("k1") + F.col("e") * F.col("k2")) / F.col("k2")
    picked = k.select_theta(s.filter("split = 'cal'"), LOG_GRID)
    note = F.concat_ws(" ", F.when(F.col("theta") == FROZEN, "FROZEN"), F.when(F.col("theta") == F.lit(picked).cast("double"), "CAL-SELECTED"))
    out = pts.withColumn("latency_reduction", red).withColumn("note", note)
    return rnd(out.select(*POINT_COLS, *[f"dr_{c}" for c in CHANNELS], "latency_reduction", "note"), "e", "tpr", "fpr", *[f"dr_{c}" for c in CHANNELS], "latency_reduction")


N_BOOT = 1000
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
           0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336]


def boot_ctes(src, key, seed, cols, n=N_BOOT):
    """CTE ``bw``: every row once per replicate with its Poisson count ``w``."""
    w = " + ".join(f"(case when u>={p!r}e0 then 1 else 0 end)" for p in POISSON)
    return f"""b0 as (select {cols}, g, md5('{seed}:' || g || ':' || {key}) as h from {src}, range({-(-n // 4)}) as r(g)),
  b1 as (select {cols}, g*4+j as rep, (('0x' || substr(h, (8*j+1)::int, 8))::bigint + 0.5e0)/4294967296e0 as u from b0, range(4) as l(j)),
  bw as materialized (select {cols}, rep, {w} as w from b1 where rep < {n})"""


BOOT_GAP = (boot_ctes("sus", "row_id", 0, "label, p1, s2") + """, n as (select rep, sum(w*(1-label)) nb, sum(w*label) na, sum(case when label=0 and p1<0.7e0 then w else 0 end) neb from bw group by 1),
  x as (select rep, s2, w, sum(w) over (partition by rep order by s2) as cum from bw where label=0 and p1<0.7e0),
  t as (select n.rep, min(s2) as t2 from x join n using (rep) where cum > ceil((neb-1)*(1e0-least(1e0,0.01e0*nb/neb))) group by 1),
  y as (select rep, s2, sum(w) over (partition by rep order by s2) as cum from bw where label=0), a as (select n.rep, min(s2) as ta from y join n using (rep) where cum > ceil((nb-1)*(1e0-0.01e0)) group by 1),
  v as (select rep, sum(case when p1<0.7e0 and s2>t2 then w else 0 end)*1e0/sum(w) as c, sum(case when s2>ta then w else 0 end)*1e0/sum(w) as z from bw join t using (rep) join a using (rep) where label=1 group by 1),
  f as (select """ + ", ".join(f"round(quantile_cont({e},{q}),6) as {nm}_{s}" for nm, e in (("cascade_tpr", "c"), ("stage2_dr", "z"), ("gap", "c-z")) for s, q in (("lo", 0.025), ("median", 0.5), ("hi", 0.975)))
       + ", count(*)::bigint as n_boot from v)")


@query("bootstrap_gap", with_(SCORED, SUS, BOOT_GAP) + " select *, case when gap_lo>0 then 'exceeds' when gap_hi<0 then 'worse' else 'matches' end as verdict from f")
def bootstrap_gap(spark, d):
    g = b.gap(suspicious(spark, d), "row_id", 0.7, n=N_BOOT)
    return rnd(g, *[c for c in g.columns if c not in ("n_boot", "verdict")])


@query("bootstrap_gap_cells")
def bootstrap_gap_cells(spark, d):
    """The same interval from counts by cell, whose work does not grow with rows x replicates; its draws are not those of a row's digest."""
    g = cellboot.gap(suspicious(spark, d), 0.7, n=N_BOOT)
    return rnd(g, *[c for c in g.columns if c not in ("n_boot", "verdict")])


DIFF = "hits as (select row_id, source, (case when s2>0.6e0 then 1e0 else 0e0 end) - (case when s1>0.6e0 then 1e0 else 0e0 end) as diff from sus where label=1)"


@query("bootstrap_paired", with_(SCORED, SUS, DIFF, boot_ctes("hits", "row_id", 0, "source, diff")) + """, mm as (select source, rep, sum(diff*w)/nullif(sum(w),0) as v from bw group by 1,2),
  ci as (select source, quantile_cont(v,0.025) lo, quantile_cont(v,0.975) hi from mm group by 1)
  select source, round(avg(diff),6) as delta, count(*)::bigint as n, round(max(lo),6) as lo, round(max(hi),6) as hi from hits join ci using (source) group by 1""")
def bootstrap_paired(spark, d):
    s = suspicious(spark, d).filter("label = 1")
    hits = s.withColumn("diff", (F.col("s2") > 0.6).cast("double") - (F.col("s1") > 0.6).cast("double"))
    return rnd(b.paired(hits, "row_id", "diff", N_BOOT, 0, ["source"]), "delta", "lo", "hi")


@query("cascade_by_channel", with_(SCORED, SUS, point_ctes("sus", "[0.7e0]"), dr_ctes("sus", "label", "s2", "0.01e0")) + """
  select channel, count(*)::bigint as n, round(avg(case when s2>threshold then 1e0 else 0 end),6) as stage2_dr, round(avg(case when p1<0.7e0 and s2>theta2 then 1e0 else 0 end),6) as cascade_dr,
  count(*) filter (p1>=0.7e0)::bigint as passed, round(max(e),6) as e, round(max(tpr),6) as overall_tpr from sus, c_pt, d_res where label=1 group by 1""")
def cascade_by_channel(spark, d):
    return rnd(k.by_channel(suspicious(spark, d), 0.7), "stage2_dr", "cascade_dr", "e", "overall_tpr")


@query("leave_one_source_out", with_(SCORED, SUS, "loo as (select c.s as left_out, x.* from sus x, (select distinct source as s from sus where label=1) c where x.label=0 or x.source<>c.s)",
                                     dr_ctes("loo", "label", "s2", "0.01e0", "left_out")) + "select k as left_out, round(dr,6) as dr, n_benign, n_injection from d_res")
def leave_one_source_out(spark, d):
    """Benign rows never leave, so one threshold serves all sources: only counts per source are needed."""
    s = suspicious(spark, d)
    t = m.dr_at_fpr(s, "s2", (0.01,)).select("threshold", "n_benign")
    per = s.filter("label = 1").join(F.broadcast(t)).groupBy("source").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("s2") > F.col("threshold")).cast("long")).alias("h"), F.max("n_benign").alias("n_benign"))
    tot = per.agg(F.sum("c").alias("ct"), F.sum("h").alias("ht"))
    out = per.join(F.broadcast(tot)).select(F.col("source").alias("left_out"), ratio(F.col("ht") - F.col("h"), F.col("ct") - F.col("c")).alias("dr"), "n_benign",
                                            (F.col("ct") - F.col("c")).alias("n_injection"))
    return rnd(out, "dr")


THR = """tb1 as (select s1 as s, count(*) over (order by s1 desc)*1e0/count(*) over () g from sus where label=0), tb2 as (select s2 as s, count(*) over (order by s2 desc)*1e0/count(*) over () g from sus where label=0),
  thr as (select (select min(s) from tb1 where g<=0.01e0) t1, (select min(s) from tb2 where g<=0.01e0) t2),
  miss as (select *, case when s1<t1 then 1 else 0 end as m1, case when s2<t2 then 1 else 0 end as m2 from sus, thr where label=1)"""
OV_COLS = ("stage1_dr", "stage2_dr", "p_both_miss", "p_s2_miss_given_s1_miss", "lift", "excess", "phi", "union_dr", "stage2_rescue", "stage1_rescue")


def overlap_sql(key):
    head = f"{key} as k, " if key else ""
    tail = " group by 1" if key else ""
    return f"""(select {head}count(*)::bigint as n, sum(1-greatest(m1,m2))::bigint as both_flag, sum((1-m1)*m2)::bigint as s1_only, sum(m1*(1-m2))::bigint as s2_only, sum(m1*m2)::bigint as both_miss,
   round(1e0-avg(m1),6) as stage1_dr, round(1e0-avg(m2),6) as stage2_dr, round(avg(m1*m2),6) as p_both_miss, round(sum(m1*m2)*1e0/nullif(sum(m1),0),6) as p_s2_miss_given_s1_miss,
   round(sum(m1*m2)*1e0/nullif(sum(m1),0)/nullif(avg(m2),0),6) as lift, round(avg(m1*m2)/nullif(avg(m1)*avg(m2),0),6) as excess, round(corr(m1,m2),6) as phi,
   round(1e0-avg(m1*m2),6) as union_dr, round(sum(m1*(1-m2))*1e0/nullif(sum(m1),0),6) as stage2_rescue, round(sum((1-m1)*m2)*1e0/nullif(sum(m2),0),6) as stage1_rescue from miss{tail})"""


@query("failure_overlap", with_(SCORED, SUS, THR) + f""", r as (select rank() over (order by s1) + (count(*) over (partition by s1)-1)/2e0 as a, rank() over (order by s2) + (count(*) over (partition by s2)-1)/2e0 as b from miss)
  select o.*, (select round(corr(a,b),6) from r) as spearman from {overlap_sql(None)} o""")
def failure_overlap(spark, d):
    miss = k.overlap(suspicious(spark, d))
    out = m.one_row(k.overlap_table(miss), m.spearman(suspicious(spark, d).filter("label = 1"), "s1", "s2"))
    return rnd(out, *OV_COLS, "spearman")


@query("overlap_by_slice", with_(SCORED, SUS, THR) + f"select 'source' as slice_by, * from {overlap_sql('source')} union all select 'channel', * from {overlap_sql('channel')}")
def overlap_by_slice(spark, d):
    miss = k.overlap(suspicious(spark, d))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("slice_by"), F.col(x).alias("k")) for x in ("source", "channel")]))
    rows = miss.select("m1", "m2", each.alias("f")).select("m1", "m2", "f.*")
    return rnd(k.overlap_table(rows, ["slice_by", "k"]), *OV_COLS)


@query("cascade_counterfactual", with_(SCORED, SUS, THR) + """select 0.7e0 as theta, count(*) filter (p1>=0.7e0)::bigint as passed, round(avg(case when p1>=0.7e0 then 1e0 else 0 end),6) as passed_frac,
  round(avg(1-m2) filter (p1>=0.7e0),6) as stage2_dr_on_passed, round(avg(1-m2) filter (p1<0.7e0),6) as stage2_dr_on_escalated, round(avg(1-m2),6) as stage2_dr from miss""")
def cascade_counterfactual(spark, d):
    hit, out_ = 1 - F.col("m2"), F.col("p1") >= 0.7
    r = k.overlap(suspicious(spark, d)).agg(
        F.lit(0.7).alias("theta"), F.sum(out_.cast("long")).alias("passed"), F.avg(out_.cast("int")).alias("passed_frac"), F.avg(F.when(out_, hit)).alias("stage2_dr_on_passed"),
        F.avg(F.when(~out_, hit)).alias("stage2_dr_on_escalated"), F.avg(hit).alias("stage2_dr"))
    return rnd(r, "passed_frac", "stage2_dr_on_passed", "stage2_dr_on_escalated", "stage2_dr")


EDGES = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


@query("dr_by_score_bin", with_(SCORED, SUS, THR) + f"""select ({' + '.join(f'(case when p1>={e!r}e0 then 1 else 0 end)' for e in EDGES)})::int as bin, count(*)::bigint as n, round(avg(1-m2),6) as stage2_dr from miss group by 1""")
def dr_by_score_bin(spark, d):
    miss = m.band_by_cuts(k.overlap(suspicious(spark, d)), "p1", EDGES, "bin")
    return rnd(miss.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("m2")).alias("stage2_dr")), "stage2_dr")


@query("contamination_rescore", with_(SCORED, SUS, dr_ctes("sus", "label", "s2", "0.01e0"), point_ctes("sus", "[0.7e0]")) + """select round(avg(case when s2>threshold then 1e0 else 0 end),6) as stage2_all,
  round(avg(case when channel<>'document' then case when s2>threshold then 1e0 else 0 end end),6) as stage2_without, round(avg(case when p1<0.7e0 and s2>=theta2 then 1e0 else 0 end),6) as cascade_all,
  round(avg(case when channel<>'document' then case when p1<0.7e0 and s2>=theta2 then 1e0 else 0 end end),6) as cascade_without from sus, d_res, c_pt where label=1""")
def contamination_rescore(spark, d):
    """The benign rows stay, so both thresholds stay; only the attack side loses a channel."""
    s = suspicious(spark, d)
    t = m.dr_at_fpr(s, "s2", (0.01,)).select("threshold")
    pt = k.cascade_at(s, 0.7).select("theta2")
    a = s.filter("label = 1").join(F.broadcast(t)).join(F.broadcast(pt))
    keep = F.col("channel") != "document"
    alone = (F.col("s2") > F.col("threshold")).cast("int")
    casc = ((F.col("p1") < 0.7) & (F.col("s2") >= F.col("theta2"))).cast("int")
    r = a.agg(F.avg(alone).alias("stage2_all"), F.avg(F.when(keep, alone)).alias("stage2_without"), F.avg(casc).alias("cascade_all"), F.avg(F.when(keep, casc)).alias("cascade_without"))
    return rnd(r, *r.columns)


@query("seen_vs_unseen", with_(SCORED, SUS, "sv as (select * from sus where split in ('val','eval'))",
                               "chb as (select split || '/all' as grp, s2, label from sv union all select x.split || '/' || c.ch, x.s2, x.label from sv x, (select unnest(['document','tool','direct']) as ch) c where x.label=0 or x.channel=c.ch)",
                               auroc_sql("chb", "label", "s2", "grp"), dr_ctes("sv", "label", "s2", "0.01e0", "split", "d1"), dr_ctes("sv", "label", "s2", "0.05e0", "split", "d5")) + """,
  pc as (select x.split || '/' || coalesce(y.ch,'') as grp, x.split, count(*)::bigint as n_attacks, avg(case when case when y.ch='all' then s2>d1_res.threshold else s2>=d1_res.threshold end then 1e0 else 0 end) as d1,
   avg(case when case when y.ch='all' then s2>d5_res.threshold else s2>=d5_res.threshold end then 1e0 else 0 end) as d5 from sv x join d1_res on d1_res.k=x.split join d5_res on d5_res.k=x.split,
   (select unnest(['all','document','tool','direct']) as ch) y where x.label=1 and (y.ch='all' or y.ch=x.channel) group by 1,2),
  w as (select pc.grp, split, n_attacks, round(d1,4) as dr_1pct, round(d5,4) as dr_5pct, round(auroc,4) as auroc from pc join a_res on a_res.k=pc.grp)
  select w.*, (select case when s.dr_1pct>=0.5 and u.dr_1pct<0.2 then 'generalization gap' when s.dr_1pct<0.5 then 'channel limit' else 'mixed' end from w s, w u where s.grp='val/document' and u.grp='eval/document') as verdict from w""")
def seen_vs_unseen(spark, d):
    s = suspicious(spark, d).filter(F.col("split").isin("val", "eval"))
    t = m.dr_at_fpr(s, "s2", (0.01, 0.05), ["split"])
    thr = t.groupBy("split").agg(*[F.max(F.when(F.col("fpr_target") == f, F.col("threshold"))).alias(n) for f, n in ((0.01, "t1"), (0.05, "t5"))])
    att = s.filter("label = 1").join(F.broadcast(thr), "split")  # one row per split
    att = att.withColumn("ch", F.explode(F.array(F.lit("all"), F.col("channel"))))

    def over(tc):
        # The overall rate uses the strict rule of the metric, the channel rows the inclusive rule of the report.
        return F.when(F.col("ch") == "all", F.col("s2") > F.col(tc)).otherwise(F.col("s2") >= F.col(tc)).cast("int")

    rows = att.groupBy("split", "ch").agg(F.count(F.lit(1)).alias("n_attacks"), F.avg(over("t1")).alias("d1"), F.avg(over("t5")).alias("d5"))
    rows = rows.withColumn("grp", F.concat_ws("/", "split", "ch"))
    groups = channel_vs_benign(s.withColumnRenamed("split", "sp")).withColumn("grp", F.concat_ws("/", "sp", "grp"))
    w = rows.join(m.auroc(groups, "s2", ["grp"]), "grp").select("grp", "split", "n_attacks", F.round("d1", 4).alias("dr_1pct"), F.round("d5", 4).alias("dr_5pct"), F.round("auroc", 4).alias("auroc"))
    pick = lambda g: F.max(F.when(F.col("grp") == g, F.col("dr_1pct")))
    seen, unseen = pick("val/document"), pick("eval/document")
    verdict = w.agg(F.when((seen >= 0.5) & (unseen < 0.2), "generalization gap").when(seen < 0.5, "channel limit").otherwise("mixed").alias("verdict"))
    return w.join(F.broadcast(verdict))


ARMS = """armr as (select row_id, source as payload_class, 'A_original' as arm, -1 as variant, s2 as s from sus where label=1 union all
  select row_id, source, 'B_reword', row_id%3, s2*0.9e0 from sus where label=1 union all select row_id, source, 'C_seen_swap', row_id%4, (s1+s2)/2e0 from sus where label=1)"""


def arm_scores(spark, d):
    """Each attack scored under three arms; the two edited arms have their own scores."""
    a = suspicious(spark, d).filter("label = 1")
    arms = F.array(F.struct(F.lit("A_original").alias("arm"), F.lit(-1).cast("long").alias("variant"), F.col("s2").alias("s")),
                   F.struct(F.lit("B_reword").alias("arm"), (F.col("row_id") % 3).alias("variant"), (F.col("s2") * 0.9).alias("s")),
                   F.struct(F.lit("C_seen_swap").alias("arm"), (F.col("row_id") % 4).alias("variant"), ((F.col("s1") + F.col("s2")) / 2.0).alias("s")))
    return a.select("row_id", F.col("source").alias("payload_class"), F.explode(arms).alias("x")).select("row_id", "payload_class", "x.*")


@query("arms_intersect", with_(SCORED, SUS, ARMS) + "select row_id, count(distinct arm)::bigint as n_arms from armr group by 1 having count(distinct arm)=3")
def arms_intersect(spark, d):
    x = arm_scores(spark, d).groupBy("row_id").agg(F.size(F.collect_set("arm")).cast("long").alias("n_arms"))
    return x.filter("n_arms = 3")


@query("reword_analysis", with_(SCORED, SUS, ARMS, "bt as (select quantile_cont(s2,0.99) as t from sus where label=0)",
                                "ab as (select arm, s, 1 as label from armr union all select a.arm, s2, 0 from sus, (select distinct arm from armr) a where label=0)", auroc_sql("ab", "label", "s", "arm")) + """,
  f as (select 'arm' as facet, arm, '' as item, count(*)::bigint as n, round(avg(case when s>=t then 1e0 else 0 end),6) as dr, round(median(s),6) as median_score from armr, bt group by 2
   union all select 'class', arm, payload_class, count(*)::bigint, round(avg(case when s>=t then 1e0 else 0 end),6), null from armr, bt group by 2,3
   union all select 'variant', arm, variant::varchar, count(*)::bigint, round(avg(case when s>=t then 1e0 else 0 end),6), null from armr, bt where arm<>'A_original' group by 2,3)
  select f.facet, f.arm, f.item, f.n, f.dr, f.median_score, case when facet='arm' then round(auroc,6) end as auroc, case when facet='arm' then round(f.dr - (select dr from f where facet='arm' and arm='A_original'),6) end as delta from f join a_res on a_res.k=f.arm""")
def reword_analysis(spark, d):
    s = suspicious(spark, d)
    t = quantiles(s, "s2", {"t": 0.99}, where=F.col("label") == 0)
    arms = arm_scores(spark, d)
    hit = (F.col("s") >= F.col("t")).cast("int")
    rows = arms.join(F.broadcast(t)).select("arm", "payload_class", F.col("variant").cast("string").alias("variant"), hit.alias("hit"))
    facets = F.array(F.struct(F.lit("arm").alias("facet"), F.lit("").alias("item")), F.struct(F.lit("class").alias("facet"), F.col("payload_class").alias("item")),
                     F.struct(F.when(F.col("arm") != "A_original", "variant").alias("facet"), F.col("variant").alias("item")))
    f = rows.select("arm", "hit", F.explode(facets).alias("x")).select("arm", "hit", "x.*").filter(F.col("facet").isNotNull())
    f = f.groupBy("facet", "arm", "item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("dr"))
    names = F.array(*[F.lit(x) for x in ("A_original", "B_reword", "C_seen_swap")])
    pool = arms.select("arm", "s", F.lit(1).cast("long").alias("label")).unionByName(
        s.filter("label = 0").select(F.explode(names).alias("arm"), F.col("s2").alias("s"), "label"))
    extra = m.auroc(pool, "s", ["arm"]).join(quantiles(arms, "s", {"median_score": 0.5}, ["arm"]), "arm").withColumn("facet", F.lit("arm"))
    base = f.filter("facet = 'arm' and arm = 'A_original'").select(F.col("dr").alias("dr0"))
    out = f.join(extra, ["facet", "arm"], "left").join(F.broadcast(base))
    out = out.withColumn("delta", F.when(F.col("facet") == "arm", F.round(F.col("dr") - F.col("dr0"), 6))).drop("dr0")
    return rnd(out, "median_score", "auroc")


@query("threshold_transfer", with_(SCORED, SUS, "calr as (select * from sus where split='cal')", dr_ctes("calr", "label", "s2", "0.01e0")) + """
  select split, max(threshold) as theta2, round(avg(case when label=0 then case when s2>=threshold then 1e0 else 0 end end),6) as fpr, round(avg(case when label=1 then case when s2>=threshold then 1e0 else 0 end end),6) as dr from sus, d_res group by 1""")
def threshold_transfer(spark, d):
    s = suspicious(spark, d)
    t = m.dr_at_fpr(s.filter("split = 'cal'"), "s2", (0.01,)).select(F.col("threshold").alias("theta2"))
    over = (F.col("s2") >= F.col("theta2")).cast("int")
    out = s.join(F.broadcast(t)).groupBy("split").agg(F.max("theta2").alias("theta2"), F.avg(F.when(F.col("label") == 0, over)).alias("fpr"), F.avg(F.when(F.col("label") == 1, over)).alias("dr"))
    return rnd(out, "fpr", "dr")


@query("generalization_gap", with_(SCORED, SUS, dr_ctes("sus", "label", "s1", "0.01e0", "split", "x"), dr_ctes("sus", "label", "s2", "0.01e0", "split", "y")) + """,
  u as (select 'stage1' as detector, k, dr from x_res union all select 'stage2', k, dr from y_res) select detector, round(max(case when k='val' then dr end),6) as val, round(max(case when k='eval' then dr end),6) as eval,
  round(max(case when k='val' then dr end) - max(case when k='eval' then dr end),6) as gap from u group by 1""")
def generalization_gap(spark, d):
    s = suspicious(spark, d)
    both = F.array(F.struct(F.lit("stage1").alias("detector"), F.col("s1").alias("s")), F.struct(F.lit("stage2").alias("detector"), F.col("s2").alias("s")))
    rows = s.select("split", "label", F.explode(both).alias("x")).select("split", "label", "x.*")
    dr = m.dr_column(rows, "s", 0.01, ["detector", "split"])
    wide = dr.groupBy("detector").pivot("split", ["val", "eval"]).agg(F.max("dr"))
    return rnd(wide.withColumn("gap", F.col("val") - F.col("eval")), "val", "eval", "gap")


@query("route_counts", with_(SCORED) + "select count(*) filter (p1<0.7e0 and p1>0.2e0)::bigint as escalated, count(*) filter (p1>=0.7e0 and label=1)::bigint as passed_attacks, count(*) filter (p1<=0.2e0 and label=0)::bigint as blocked_benign from scored")
def route_counts(spark, d):
    return k.route_counts(scored(spark, d), 0.7, 0.2)


SAFE_GRID, UNSAFE_GRID = k.theta_grid(0.5, 1.0, 0.05), k.theta_grid(0.0, 0.5, 0.05)


@query("operating_point", with_(SCORED) + f""", g as (select unnest({lst(SAFE_GRID)}) as ts, unnest(range({len(SAFE_GRID)})) as i), h as (select unnest({lst(UNSAFE_GRID)}) as tu, unnest(range({len(UNSAFE_GRID)})) as j),
  p as (select i, j, ts, tu, count(*) filter (p1<ts and p1>tu) as esc, count(*) filter (p1>=ts and label=1) as pa, count(*) filter (p1<=tu and label=0) as bb, count(*) as n, sum(1-label) as nb from g, h, scored where tu<ts group by 1,2,3,4),
  c as (select * from p where pa=0 and bb*1e0/nb<=0.3e0 order by esc, i, j limit 1)
  select count(c.i)>0 as feasible, max(c.ts) as theta_safe, max(c.tu) as theta_unsafe, round(max(c.esc*1e0/c.n),6) as e, round(max(c.bb*1e0/c.nb),6) as fpr, max(c.pa)::bigint as passed_attacks, max(c.bb)::bigint as blocked_benign,
  (select min(pa) from p)::bigint as min_passed, round((select min(bb*1e0/nb) from p where pa=0),6) as min_fpr_zero_passed from c""")
def operating_point(spark, d):
    pts = k.operating_points(scored(spark, d), SAFE_GRID, UNSAFE_GRID)
    return rnd(k.choose_operating_point(pts, 0.3), "e", "fpr", "min_fpr_zero_passed")


# Calibration -------------------------------------------------------------------------------------
GAPS = "gaps as (select row_id, label, split, 3e0*(ln(p1)-ln(1e0-p1)) as z, ln(p1) as lb, ln(1e0-p1) as li from scored)"
NLL = "(greatest(-z/{t},0e0) + ln(1e0+exp(-abs(z/{t}))) - label*(-z/{t}))"
TEMPS = (0.5, 1.0, 2.0, 3.0, 5.0)


def gaps(spark, d):
    s = scored(spark, d)
    return s.select("row_id", "label", "split", (F.lit(3.0) * (F.log("p1") - F.log(1.0 - F.col("p1")))).alias("z"), F.log("p1").alias("logp_benign"), F.log(1.0 - F.col("p1")).alias("logp_injection"))


@query("nll_at_T", with_(SCORED, GAPS) + " union all ".join(f"select split, {t!r}e0 as T, round(avg({NLL.format(t=repr(t) + 'e0')}),6) as nll from gaps group by 1" for t in TEMPS))
def nll_at_T(spark, d):
    return rnd(cal.nll(gaps(spark, d), TEMPS, ["split"]), "nll")


def fit_ctes(src, tag):
    """CTE ``{tag}_fit(T)``: three nested grid searches, fine enough for four decimals."""
    return f"""{tag}_g1 as (select exp(-4.7e0 + i*9.4e0/200) as t from range(201) r(i)), {tag}_l1 as (select arg_min(t, l) as t from (select t, avg({NLL.format(t='t')}) as l from {src}, {tag}_g1 group by 1)),
 {tag}_g2 as (select (select t from {tag}_l1)*exp(-0.05e0 + i*0.1e0/400) as t from range(401) r(i)), {tag}_l2 as (select arg_min(t, l) as t from (select t, avg({NLL.format(t='t')}) as l from {src}, {tag}_g2 group by 1)),
 {tag}_g3 as (select (select t from {tag}_l2)*exp(-0.0005e0 + i*0.001e0/400) as t from range(401) r(i)), {tag}_fit as (select arg_min(t, l) as T, min(l) as nll from (select t, avg({NLL.format(t='t')}) as l from {src}, {tag}_g3 group by 1))"""


@query("fit_temperature", with_(SCORED, GAPS, "cg as (select * from gaps where split='cal')", fit_ctes("cg", "f")) + """select round(T,4) as T, round(nll,6) as nll,
  (select round(avg(z*z/(T*T*T*T)*(1e0/(1e0+exp(-z/T)))*(1e0/(1e0+exp(z/T)))),4) from cg) as curvature, (select count(*) from cg)::bigint as n_fit from f_fit""")
def fit_temperature(spark, d):
    g = gaps(spark, d).filter("split = 'cal'").select("label", "z")
    t = cal.fit_temperature(g)
    return cal.temperature_report(g, t).select(F.round("T", 4).alias("T"), F.round("nll", 6).alias("nll"), F.round("curvature", 4).alias("curvature"), "n_fit")


@query("apply_temperature", with_(SCORED, GAPS) + "select row_id, round(lb/2e0,6) as logp_benign, round(li/2e0,6) as logp_injection, round(1e0/(1e0+exp(-(lb-li)/2e0)),6) as p_safe from gaps")
def apply_temperature(spark, d):
    return rnd(cal.apply_temperature(gaps(spark, d).select("row_id", "logp_benign", "logp_injection"), 2.0), "logp_benign", "logp_injection", "p_safe")


def report_sql(src, split, variant, t):
    terms = " + ".join(f"(case when c >= {i / 10!r}e0 then 1 else 0 end)" for i in range(1, 10))
    return f"""select '{split}' as split, '{variant}' as variant, round({t},2) as T, (select round(sum(n*abs(mc-ob))/sum(n),2) from (select {terms} as bin, avg(c) mc, avg(label) ob, count(*) n from
   (select label, 1e0/(1e0+exp(z/({t}))) as c from {src}) group by 1)) as ece, (select round(avg({NLL.format(t='(' + t + ')')}),3) from {src}) as nll, (select round(auroc,4) from au_res where k='{split}') as auroc"""


@query("calibration_report", with_(SCORED, GAPS, "cg as (select * from gaps where split='cal')", "vg as (select * from gaps where split='val')", "eg as (select * from gaps where split='eval')", "sg as (select *, -z as s from gaps)",
                                   auroc_sql("sg", "label", "s", "split", "au"), fit_ctes("cg", "f"), fit_ctes("eg", "o"))
       + " union all ".join([report_sql("cg", "cal", "raw", "1e0"), report_sql("cg", "cal", "calfit", "(select T from f_fit)"), report_sql("vg", "val", "raw", "1e0"), report_sql("vg", "val", "calfit", "(select T from f_fit)"),
                             report_sql("eg", "eval", "raw", "1e0"), report_sql("eg", "eval", "calfit", "(select T from f_fit)"), report_sql("eg", "eval", "own_fit", "(select T from o_fit)")]))
def calibration_report(spark, d):
    g = gaps(spark, d).select("label", "split", "z")
    fits = cal.fit_temperatures(g.filter("split in ('cal', 'eval')"), ["split"])
    t_cal, t_own = fits[("cal",)], fits[("eval",)]
    forms = [F.struct(F.lit("raw").alias("variant"), F.lit(1.0).alias("T")), F.struct(F.lit("calfit").alias("variant"), F.lit(t_cal).alias("T"))]
    own = F.struct(F.lit("own_fit").alias("variant"), F.lit(t_own).alias("T"))
    rows = g.select("*", F.explode(F.when(F.col("split") == "eval", F.array(*forms, own)).otherwise(F.array(*forms))).alias("f")).select("label", "split", "z", "f.*")
    rows = rows.withColumn("conf", 1.0 - sigmoid(F.col("z") / F.col("T")))
    loss = rows.groupBy("split", "variant", "T").agg(F.avg(injection_nll(F.col("z"), F.col("label"), F.col("T"))).alias("nll"))
    e = m.ece(rows, "conf", ["split", "variant"])
    # The area does not depend on T, so it is taken once per split.
    a = m.auroc(g.withColumn("s", -F.col("z")), "s", ["split"])
    out = loss.join(e, ["split", "variant"]).join(a, "split")
    return out.select("split", "variant", F.round("T", 2).alias("T"), F.round("ece", 2).alias("ece"), F.round("nll", 3).alias("nll"), F.round("auroc", 4).alias("auroc"))


@query("isotonic", with_(SCORED) + """, c as (select p1, sum(1-label)::double as s, count(*)::double as w from scored where split='cal' group by 1),
  n as (select p1, row_number() over (order by p1) as i, s, w, sum(s) over (order by p1) as cs, sum(w) over (order by p1) as cw from c),
  j as (select a.i as j, b.i as i, min((b.cs-a.cs+a.s)/(b.cw-a.cw+a.w)) over (partition by a.i order by b.i desc) as m from n a join n b on b.i>=a.i),
  f as (select n.i, n.p1 as x, v from n join (select i, max(m) as v from j group by 1) using (i)),
  g as (select x, v, lead(x) over (order by x) as x1, lead(v) over (order by x) as v1, row_number() over (order by x) as k from f)
  select row_id, scored.p1, label, split, round(case when scored.p1 < x then v when x1 is null then v else v + (v1-v)*(scored.p1-x)/(x1-x) end,6) as p_iso
  from scored asof left join (select case when k=1 then '-infinity'::double else x end as from_x, * from g) g on scored.p1 >= g.from_x""")
def isotonic(spark, d):
    s = scored(spark, d)
    blocks = cal.isotonic(s.filter("split = 'cal'"))
    return rnd(cal.apply_isotonic(s.select("row_id", "p1", "label", "split"), blocks), "p_iso")
