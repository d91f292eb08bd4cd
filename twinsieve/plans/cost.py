"""Registered cost queries (survey part 2.8) and the curve joins of part 2.5."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.functions import money
from twinsieve.operators import bootstrap as b
from twinsieve.operators import cascade as k
from twinsieve.operators import cost as c
from twinsieve.operators import metrics as m
from twinsieve.operators import reports as rep
from twinsieve.operators.ranks import cut_points, quantiles
from twinsieve.plans.cascade import BOOT_GAP, MED512, N_BOOT, k1_k2, point_ctes
from twinsieve.plans.fixture_sql import SAMPLES, SCORED, auroc_sql, dr_ctes, with_
from twinsieve.plans.metrics import SUS, rnd, suspicious
from twinsieve.plans.registry import query
from twinsieve.plans.sources import curve_points
from twinsieve.sources.readers import stored
from twinsieve.sources.tables import samples, scored

OOD_SHARE = 0.7237
CELL = ["regime", "model", "role", "target_tokens"]


def merged_curve(spark, d):
    """Base session with the later one laid over it. A curve has models x lengths rows, so it is pinned."""
    pts = c.pinned(curve_points(samples(spark, d), "regime", "session"))
    return c.overlay(pts.filter("session = 'base'"), pts.filter("session = 'extra'"), CELL)


CURVE_CTES = """sess as (select regime, session, model, role, target_tokens, max(actual_tokens) as actual_tokens, quantile_cont(ms,0.5) as median_ms from samples group by 1,2,3,4,5),
 cv as (select regime, model, role, target_tokens, coalesce(x.actual_tokens, b.actual_tokens) as actual_tokens, coalesce(x.median_ms, b.median_ms) as median_ms, x.median_ms/b.median_ms-1 as drift
  from (select * from sess where session='base') b full join (select * from sess where session='extra') x using (regime, model, role, target_tokens))"""
PAIR_CTE = """pr as (select a.regime, a.model, a.target_tokens, a.median_ms as k1, b.median_ms as k2, a.actual_tokens as tokens1, b.actual_tokens as tokens2
  from cv a join cv b on a.regime=b.regime and a.target_tokens=b.target_tokens and a.role='stage1' and b.model='large')"""
SEG_CTES = """an as (select model, actual_tokens::double as x, avg(median_ms) as y from cv where regime='nf4' group by 1,2),
 sg as (select model, x, y, lead(x) over (partition by model order by x) as x1, lead(y) over (partition by model order by x) as y1, min(x) over (partition by model) as xm from an)"""


def lookup_sql(src, model, tokens, name):
    return (f"(select {src}.*, y + coalesce((y1-y)/(x1-x),0e0)*(greatest({tokens}, x)-x) as {name} from {src} join sg on sg.model='{model}' "
            f"and ({tokens} >= x or x = xm) and ({tokens} < x1 or x1 is null))")


@query("curve_overlay", with_(SAMPLES, CURVE_CTES) + "select regime, model, role, target_tokens, actual_tokens, round(median_ms,6) as median_ms, round(drift,6) as drift from cv")
def curve_overlay(spark, d):
    out = merged_curve(spark, d)
    return rnd(out.select(*CELL, "actual_tokens", "median_ms", "drift"), "median_ms", "drift")


@query("anchor_pairs", with_(SAMPLES, CURVE_CTES, PAIR_CTE) + "select regime, model, target_tokens, tokens1, tokens2, round(k1,6) as k1_ms, round(k2,6) as k2_ms, round(k1/k2,6) as ratio, round(1-k1/k2,6) as break_even_e from pr")
def anchor_pairs(spark, d):
    p = c.anchor_pairs(merged_curve(spark, d), ["regime"], "large")
    p = p.withColumn("ratio", F.try_divide(F.col("k1_ms"), F.col("k2_ms"))).withColumn("break_even_e", money.break_even(F.col("k1_ms"), F.col("k2_ms")))
    return rnd(p.select("regime", "model", "target_tokens", "tokens1", "tokens2", "k1_ms", "k2_ms", "ratio", "break_even_e"), "k1_ms", "k2_ms", "ratio", "break_even_e")


def priced(spark, d, s=None):
    """Scored rows with both stages' latency read off the merged curve."""
    seg = c.pinned(c.segments(merged_curve(spark, d).filter("regime = 'nf4'")))
    s = scored(spark, d) if s is None else s
    return c.interp(c.interp(s, "n_tokens", seg, "small-a", "k1"), "n_tokens", seg, "large", "k2").withColumn("esc", (F.col("p1") < 0.7).cast("int"))


PRICED = ["priced1 as " + lookup_sql("scored", "small-a", "n_tokens", "k1"), "priced as (select *, case when p1<0.7e0 then 1 else 0 end as esc from " + lookup_sql("priced1", "large", "n_tokens", "k2") + ")"]
PRICE_BASE = with_(SCORED, SAMPLES, CURVE_CTES, SEG_CTES, *PRICED)


@query("interp_lookup", PRICE_BASE + "select row_id, n_tokens, round(k1,4) as k1, round(k2,4) as k2 from priced")
def interp_lookup(spark, d):
    # Four digits: midpoints between two anchors sit on rounding ties further down.
    return priced(spark, d).select("row_id", "n_tokens", F.round("k1", 4).alias("k1"), F.round("k2", 4).alias("k2"))


NAMES = ["qwen2.5-1.5b", "llama3.2-1b", "granite-guardian-2b", "datasentinel_7b", "other"]
DET = "det as (select *, (['" + "','".join(NAMES) + "'])[(row_id%5)::int+1] as detector from scored)"
PROF = "prof as (select * from (values " + ", ".join(f"('{n}',{p}::bigint,'{dt}',{by!r}e0)" for n, p, dt, by in money.PROFILES) + ") v(detector, param_count, load_dtype, bpp))"


def detectors(spark, d):
    return scored(spark, d).withColumn("detector", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("row_id") % 5 + 1).cast("int")))


@query("profile_lookup", with_(SCORED, DET, PROF) + "select row_id, detector, param_count, load_dtype, round(param_count*bpp*1.2e0/1e9,6) as vram_gb, 2e0*param_count*512 as flops from det left join prof using (detector)")
def profile_lookup(spark, d):
    out = c.with_profile(detectors(spark, d).select("row_id", "detector"), "detector")
    return rnd(out.select("row_id", "detector", "param_count", "load_dtype", "vram_gb", "flops"), "vram_gb")


@query("detector_cost", with_(SCORED, DET, PROF) + """select detector, round(avg(ms),6) as mean_latency_ms, round(avg(ms),6) as gpu_s_per_1k, round(avg(ms)/1e3*1e6/3600e0*1.2e0,6) as usd_per_1m,
  max(param_count) as param_count, max(load_dtype) as load_dtype, round(max(param_count*bpp*1.2e0/1e9),6) as vram_gb, max(2e0*param_count*512) as flops from det left join prof using (detector) group by 1""")
def detector_cost(spark, d):
    return rnd(c.detector_cost(detectors(spark, d), "detector", "ms"), "mean_latency_ms", "gpu_s_per_1k", "usd_per_1m", "vram_gb")


def regime_escalation(spark, d):
    """Escalation measured per number regime: the same cut on two score columns."""
    s = scored(spark, d)
    e = s.agg(F.avg((F.col("p1") < 0.7).cast("int")).alias("nf4"), F.avg((F.col("p1") < 0.68).cast("int")).alias("bf16"))
    packed = F.array(*[F.struct(F.lit(r).alias("regime"), F.col(r).alias("e")) for r in ("nf4", "bf16")])
    return e.select(F.explode(packed).alias("x")).select("x.*")


ESC_CTE = "esc as (select 'nf4' as regime, avg(case when p1<0.7e0 then 1e0 else 0 end) as e from scored union all select 'bf16', avg(case when p1<0.68e0 then 1e0 else 0 end) from scored)"
COST_BASE = with_(SCORED, SAMPLES, CURVE_CTES, PAIR_CTE, ESC_CTE)
USD = "/1e3*1e6/3600e0*1.2e0"


def pairs_with_e(spark, d):
    return c.anchor_pairs(merged_curve(spark, d), ["regime"], "large").join(F.broadcast(regime_escalation(spark, d)), "regime")


@query("cascade_cost", COST_BASE + f"""select regime, model, target_tokens, round(e,6) as e, round(k1/k2,6) as ratio, round(1-k1/k2,6) as break_even_e, e < 1-k1/k2 as cheaper, round(k1+e*k2,6) as expected_ms,
  round((k1+e*k2){USD},6) as usd_cascade, round(k2{USD},6) as usd_stage2, round(1-(k1+e*k2)/k2,6) as reduction from pr join esc using (regime)""")
def cascade_cost(spark, d):
    out = c.cascade_cost(pairs_with_e(spark, d)).select("regime", "model", "target_tokens", "e", "ratio", "break_even_e", "cheaper", "expected_ms", "usd_cascade", "usd_stage2", "reduction")
    return rnd(out, "e", "ratio", "break_even_e", "expected_ms", "usd_cascade", "usd_stage2", "reduction")


RATIOS = (0.02, 0.05, 0.1, 0.2, 0.3)


@query("cost_ratio_curve", with_(SCORED) + f""", e as (select avg(case when p1<0.7e0 then 1e0 else 0 end) as e0 from scored), r as (select unnest({list(RATIOS)!r})::double as ratio),
  g as (select unnest(range(201))/200e0 as e) select 'measured' as kind, ratio, round(e0,6) as e, round(1-ratio,4) as break_even_e, e0<1-ratio as cheaper, round((1-(ratio+e0*1e0)/1e0)*100,2) as reduction_pct from r, e
  union all select 'line', ratio, round(g.e,6), round(1-ratio,4), g.e<1-ratio, round((1-(ratio+g.e*1e0)/1e0)*100,2) from r, g""")
def cost_ratio_curve(spark, d):
    e = scored(spark, d).agg(F.avg((F.col("p1") < 0.7).cast("int")).alias("e0"))
    grid = F.array(F.struct(F.lit("measured").alias("kind"), F.col("e0").alias("e")), *[F.struct(F.lit("line").alias("kind"), F.lit(i / 200).alias("e")) for i in range(201)])
    x = e.select(F.explode(grid).alias("g")).select("g.*", F.explode(F.array(*[F.lit(r) for r in RATIOS])).alias("ratio"))
    k1, k2 = F.col("ratio"), F.lit(1.0)
    return x.select("kind", "ratio", F.round("e", 6).alias("e"), F.round(money.break_even(k1, k2), 4).alias("break_even_e"), (F.col("e") < money.break_even(k1, k2)).alias("cheaper"),
                    F.round(money.reduction(k1, k2, F.col("e")) * 100, 2).alias("reduction_pct"))


LW = ("e", "mean_k2", "mean_k1", "r_effective", "reduction", "stage2_share", "usd_base", "usd_cascade")


@query("length_weighted_cost", PRICE_BASE + f"""select source, count(*)::bigint as n, round(avg(esc),6) as e, round(avg(k2),6) as mean_k2, round(avg(k1),6) as mean_k1, round(sum(k1)/sum(k2),6) as r_effective,
  round(1-(sum(k1)+sum(k2*esc))/sum(k2),6) as reduction, round(sum(k2*esc)/sum(k2),6) as stage2_share, round(avg(k2){USD},6) as usd_base, round((sum(k1)+sum(k2*esc))/count(*){USD},6) as usd_cascade from priced group by 1""")
def length_weighted_cost(spark, d):
    return rnd(c.length_weighted(priced(spark, d), keys=["source"]), *LW)


@query("tokens_by_source", with_(SCORED) + """select source, count(*)::bigint as n, round(quantile_cont(n_tokens::double,0.5),6) as median_tokens, round(quantile_cont(n_tokens::double,0.9),6) as p90_tokens, min(n_tokens) as min_tokens, max(n_tokens) as max_tokens,
  round(avg(case when n_tokens>2048 then 1e0 else 0 end),6) as above_curve from scored group by 1""")
def tokens_by_source(spark, d):
    s, n = scored(spark, d), F.col("n_tokens")
    a = s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg((n > 2048).cast("int")).alias("above_curve"))
    return rnd(a.join(quantiles(s, "n_tokens", {"median_tokens": 0.5, "p90_tokens": 0.9}, ["source"]), "source"), "median_tokens", "p90_tokens", "above_curve")


@query("uniform_length_sweep", COST_BASE + f""", x as (select regime, model, target_tokens, k1, k2, e, 1-k1/k2-e as red from pr join esc using (regime)),
  p as (select regime, model, arg_max(target_tokens, (round(red,9), -target_tokens)) as peak_tokens, arg_max(k1/k2, target_tokens) as ratio_longest from x group by 1,2)
  select regime, model, target_tokens, round(k1/k2,4) as r, round(red,4) as reduction, round(k2{USD},2) as usd_base, round((k1+e*k2){USD},2) as usd_cascade, peak_tokens, round(ratio_longest,4) as ratio_longest from x join p using (regime, model)""")
def uniform_length_sweep(spark, d):
    x = pairs_with_e(spark, d)
    r = F.try_divide(F.col("k1_ms"), F.col("k2_ms"))
    x = x.withColumn("r", r).withColumn("reduction", F.lit(1.0) - r - F.col("e"))
    peak = x.groupBy("regime", "model").agg(F.max_by("target_tokens", F.struct(F.round("reduction", 9), -F.col("target_tokens"))).alias("peak_tokens"), F.max_by("r", "target_tokens").alias("ratio_longest"))
    out = x.join(F.broadcast(peak), ["regime", "model"])  # one row per curve
    return out.select("regime", "model", "target_tokens", F.round("r", 4).alias("r"), F.round("reduction", 4).alias("reduction"), F.round(money.usd_per_million(F.col("k2_ms")), 2).alias("usd_base"),
                      F.round(money.usd_per_million(money.expected_ms(F.col("k1_ms"), F.col("k2_ms"), F.col("e"))), 2).alias("usd_cascade"), "peak_tokens", F.round("ratio_longest", 4).alias("ratio_longest"))


MIXES = {"as_is": None, "ood": OOD_SHARE}
WEIGHTS = f"""wt as (select s.*, mix, case when label=0 then share/nb else (1e0-share)/na end as weight from {{src}} s, (select sum(1-label) nb, sum(label) na from {{src}}) n,
  lateral (select 'as_is' as mix, nb*1e0/(nb+na) as share union all select 'ood', {OOD_SHARE!r}e0) mx)"""


@query("prevalence_reweight", with_(SCORED, WEIGHTS.format(src="scored")) + "select mix, label, count(*)::bigint as n, round(sum(weight),6) as mass, round(max(weight)*1e6,6) as weight_ppm from wt group by 1,2")
def prevalence_reweight(spark, d):
    w = c.prevalence_weights(scored(spark, d).select("row_id", "label"), MIXES)
    return rnd(w.groupBy("mix", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("mass"), (F.max("weight") * 1e6).alias("weight_ppm")), "mass", "weight_ppm")


WCOST = "round(sum(weight*k2),6) as baseline_ms, round(sum(weight*(k1+esc*k2)),6) as cascade_ms, round(1-sum(weight*(k1+esc*k2))/sum(weight*k2),6) as reduction, round(sum(weight*k1)/sum(weight*k2),6) as r_effective"
WC = ("baseline_ms", "cascade_ms", "reduction", "r_effective")


@query("weighted_cost", PRICE_BASE + ", " + WEIGHTS.format(src="priced") + f" select mix, {WCOST} from wt group by 1")
def weighted_cost(spark, d):
    return rnd(c.weighted_cost(c.prevalence_weights(priced(spark, d), MIXES), "k1", "k2", ["mix"]), *WC)


QS, QN = (0.5, 0.95, 0.99), ("median_ms", "p95_ms", "p99_ms")


def wq_sql(src, value, share):
    inner = f"(select {value} as v, count(*) filter (label=0) as q, count(*) filter (label=1) as p from {src} group by 1)"
    cum = f"(select v, sum(q) over (order by v) as cq, sum(p) over (order by v) as cp, sum(q) over () as tq, sum(p) over () as tp from {inner})"
    w = "(cq+cp)*1e0/(tq+tp)" if share is None else f"(cq*1e0/tq)*{share!r}e0 + (cp*1e0/tp)*{1.0 - share!r}e0"
    return "select " + ", ".join(f"min(case when {w} >= {qq!r}e0 then v end) as {n}" for qq, n in zip(QS, QN)) + f" from {cum}"


@query("weighted_quantile", with_(SCORED) + f"select 'as_is' as mix, * from ({wq_sql('scored', 'ms', None)}) union all select 'ood', * from ({wq_sql('scored', 'ms', OOD_SHARE)})")
def weighted_quantile(spark, d):
    return c.weighted_quantiles(scored(spark, d), "ms", MIXES, QS, QN)


# Timed requests: both stages' own measurements of part of the rows.
TIMED = ["t1 as (select row_id as idx, label, n_tokens, 21e0 + n_tokens*0.25e0 + ms/16e0 as ms, p1 as p_safe from scored where split<>'cal')",
         "t2 as (select row_id as idx, label, n_tokens, 21e0 + n_tokens*2e0 + ms/8e0 as ms from scored where source<>'src0')",
         "tm as (select t1.idx as row_id, t1.label, t1.n_tokens, t1.ms as m1, t2.ms as m2, t1.p_safe, s.p1 from t1 join t2 using (idx) join scored s on s.row_id=t1.idx)"]


def timed(spark, d):
    s = scored(spark, d)
    n, ms = F.col("n_tokens"), F.col("ms")
    t1 = s.filter("split <> 'cal'").select(F.col("row_id").alias("idx"), "label", "n_tokens", (F.lit(21.0) + n * F.lit(0.25) + ms / F.lit(16.0)).alias("m1"), F.col("p1").alias("p_safe"))
    t2 = s.filter("source <> 'src0'").select(F.col("row_id").alias("idx"), F.col("label").alias("label2"), (F.lit(21.0) + n * F.lit(2.0) + ms / F.lit(8.0)).alias("m2"))
    return t1, t2


@query("idx_intersect", with_(SCORED, *TIMED) + "select row_id as idx, label, m1, m2, 0::bigint as label_mismatches from tm")
def idx_intersect(spark, d):
    t1, t2 = timed(spark, d)
    both = t1.join(t2, "idx")
    bad = both.agg(F.sum((F.col("label") != F.col("label2")).cast("long")).alias("label_mismatches"))
    return both.join(F.broadcast(bad)).select("idx", "label", "m1", "m2", "label_mismatches")


def timed_priced(spark, d):
    t1, t2 = timed(spark, d)
    both = t1.join(t2, "idx").join(scored(spark, d).select(F.col("row_id").alias("idx"), "p1"), "idx")
    return priced(spark, d, both)


TM = with_(SCORED, SAMPLES, CURVE_CTES, SEG_CTES, *TIMED, "tp1 as " + lookup_sql("tm", "small-a", "n_tokens", "k1"), "tp as (select *, case when p1<0.7e0 then 1 else 0 end as esc from " + lookup_sql("tp1", "large", "n_tokens", "k2") + ")")
ERR = ("mean", "median", "p95_abs", "max_abs", "total_bias")


def err_sql(p, meas):
    e = f"({p}-{meas})/{meas}"
    return f"round(avg({e}),6) as mean, round(quantile_cont({e},0.5),6) as median, round(quantile_cont(abs({e}),0.95),6) as p95_abs, round(max(abs({e})),6) as max_abs, round(sum({p})/sum({meas})-1,6) as total_bias"


@query("interp_error", TM + f"select 'k1' as stage, {err_sql('k1', 'm1')} from tp union all select 'k2', {err_sql('k2', 'm2')} from tp")
def interp_error(spark, d):
    # Written once: every quantile below reads it again.
    x = stored(timed_priced(spark, d).select("k1", "k2", "m1", "m2"), "timed")
    a = c.interp_error(x, "k1", "m1").withColumn("stage", F.lit("k1")).unionByName(c.interp_error(x, "k2", "m2").withColumn("stage", F.lit("k2")))
    return rnd(a.select("stage", *ERR), *ERR)


@query("measured_cost_report", TM + ", " + WEIGHTS.format(src="tp") + f""", bo as (select mix, 'measured' as basis, weight, m1 as k1, m2 as k2, esc, p1, p_safe from wt union all select mix, 'priced', weight, k1, k2, esc, p1, p_safe from wt)
  select mix, basis, {WCOST}, count(*)::bigint as n, round(max(abs(p1-p_safe)),6) as max_score_gap, sum(case when (p1<0.7e0)<>(p_safe<0.7e0) then 1 else 0 end)::bigint as routing_disagreements from bo group by 1,2""")
def measured_cost_report(spark, d):
    w = c.prevalence_weights(timed_priced(spark, d), MIXES)
    forms = F.array(F.struct(F.lit("measured").alias("basis"), F.col("m1").alias("a"), F.col("m2").alias("b")), F.struct(F.lit("priced").alias("basis"), F.col("k1").alias("a"), F.col("k2").alias("b")))
    x = w.select("mix", "weight", "esc", "p1", "p_safe", F.explode(forms).alias("f")).select("mix", "weight", "esc", "p1", "p_safe", "f.*")
    cost = c.weighted_cost(x, "a", "b", ["mix", "basis"])
    side = x.groupBy("mix", "basis").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p1") - F.col("p_safe"))).alias("max_score_gap"),
                                         F.sum(((F.col("p1") < 0.7) != (F.col("p_safe") < 0.7)).cast("long")).alias("routing_disagreements"))
    return rnd(cost.join(side, ["mix", "basis"]), *WC, "max_score_gap")


@query("indist_report", PRICE_BASE + ", " + ", ".join([SUS, point_ctes("sus", "[0.7e0]"), "calr as (select * from sus where split='cal')", point_ctes("calr", "[0.7e0]", tag="k"), BOOT_GAP, MED512, dr_ctes("sus", "label", "s2", "0.01e0", None, "d1"), dr_ctes("sus", "label", "s2", "0.001e0", None, "d01"), auroc_sql("sus", "label", "s2", None, "a"), WEIGHTS.format(src="priced")]) + f""",
  sk as (select avg(case when label=0 then case when p1>=0.7e0 then 1e0 else 0 end end) sb, avg(case when label=1 then case when p1>=0.7e0 then 1e0 else 0 end end) sa from sus),
  w as (select max(case when mix='as_is' then r end) as reduction_as_is, max(case when mix='ood' then r end) as reduction_ood from (select mix, 1-sum(weight*(k1+esc*k2))/sum(weight*k2) as r from wt group by 1))
  select round(c_pt.e,6) as e, round(sb,6) as benign_skipped, round(sa,6) as attacks_passed, c_pt.passed, (na-c_pt.caught)::bigint as missed_total, round(c_pt.tpr,6) as tpr, round(c_pt.fpr,6) as fpr, round(k_pt.e,6) as cal_e, round(k_pt.tpr,6) as cal_tpr, round(k_pt.fpr,6) as cal_fpr,
  round(1e0-(k12.k1+c_pt.e*k12.k2)/k12.k2,6) as reduction_512, round(1e0-(k12.k1+({OOD_SHARE!r}e0*(1-sb)+(1-{OOD_SHARE!r}e0)*(1-sa))*k12.k2)/k12.k2,6) as reduction_512_ood, (select quantile_cont(n_tokens,0.5)::double from scored) as tokens_median, (select round(avg(n_tokens),6) from scored) as tokens_mean, f.*, round({OOD_SHARE!r}e0*(1-sb)+(1-{OOD_SHARE!r}e0)*(1-sa),6) as e_ood, round(d1_res.dr,6) as dr_1pct, round(d01_res.dr,6) as dr_01pct, round(auroc,6) as auroc,
  (select round(max(s2),6) from sus where label=0) as max_benign, (select round(min(s2),6) from sus where label=1) as min_attack, round(reduction_as_is,6) as reduction_as_is, round(reduction_ood,6) as reduction_ood from c_pt, c_n, k_pt, k12, f, sk, d1_res, d01_res, a_res, w""")
def indist_report(spark, d):
    s = suspicious(spark, d)
    skip = (F.col("p1") >= 0.7).cast("int")
    sk = s.agg(F.avg(F.when(F.col("label") == 0, skip)).alias("benign_skipped"), F.avg(F.when(F.col("label") == 1, skip)).alias("attacks_passed"),
               F.max(F.when(F.col("label") == 0, F.col("s2"))).alias("max_benign"), F.min(F.when(F.col("label") == 1, F.col("s2"))).alias("min_attack"))
    sk = sk.withColumn("e_ood", F.lit(OOD_SHARE) * (1 - F.col("benign_skipped")) + F.lit(1 - OOD_SHARE) * (1 - F.col("attacks_passed")))
    cuts = cut_points(s, "s2")  # one sketch serves all that ranks by this score
    pt = k.cascade_at(s, 0.7, cuts=cuts).select("e", "passed", "caught", "tpr", "fpr")
    cal_pt = k.cascade_at(s.filter("split = 'cal'"), 0.7, cuts=cuts).select(*[F.col(x).alias(f"cal_{x}") for x in ("e", "tpr", "fpr")])
    boot = b.gap(s, "row_id", 0.7, n=N_BOOT).drop("verdict")
    tokens = quantiles(s, "n_tokens", {"tokens_median": 0.5}).join(F.broadcast(s.agg(F.avg("n_tokens").alias("tokens_mean"), F.sum("label").alias("_na"))))
    dr = m.dr_at_fpr(s, "s2", (0.01, 0.001), cuts=cuts).agg(*[F.max(F.when(F.col("fpr_target") == f, F.col("dr"))).alias(n) for f, n in ((0.01, "dr_1pct"), (0.001, "dr_01pct"))])
    w = c.weighted_cost(c.prevalence_weights(priced(spark, d), MIXES), "k1", "k2", ["mix"]).agg(
        *[F.max(F.when(F.col("mix") == x, F.col("reduction"))).alias(f"reduction_{x}") for x in MIXES])
    out = m.one_row(pt, sk, dr, m.auroc(s, "s2", cuts=cuts), w, cal_pt, boot, tokens, k1_k2(spark, d))
    flat = lambda e: F.lit(1.0) - (F.col("k1") + e * F.col("k2")) / F.col("k2")
    out = out.withColumns({"missed_total": F.col("_na") - F.col("caught"), "reduction_512": flat(F.col("e")), "reduction_512_ood": flat(F.col("e_ood"))}).drop("_na", "caught", "k1", "k2")
    return rnd(out, *[x for x in out.columns if x not in ("passed", "missed_total", "n_boot", "tokens_median")])


LAT = ("mean_ms", "median_ms", "p90_ms", "p95_ms", "p99_ms", "stdev_ms", "min_ms", "max_ms", "total_sec", "spread_median", "spread_p95")


@query("latency_summary", with_(SAMPLES, """each as (select regime, model, target_tokens, rep_group, count(*) as reps, quantile_cont(ms,0.5) as m, (max(ms)-min(ms))/quantile_cont(ms,0.5) as s, max(label) as y from samples group by 1,2,3,4)""",
                                "kinds as (select *, 'all' as rows from each union all select *, case when y=1 then 'attack' else 'benign' end from each)") + """
  select regime, model, target_tokens, rows, count(*)::bigint as n, sum(reps)::bigint as reps, round(avg(m),6) as mean_ms, round(quantile_cont(m,0.5),6) as median_ms, round(quantile_cont(m,0.9),6) as p90_ms, round(quantile_cont(m,0.95),6) as p95_ms,
  round(quantile_cont(m,0.99),6) as p99_ms, round(stddev_samp(m),6) as stdev_ms, round(min(m),6) as min_ms, round(max(m),6) as max_ms, round(sum(m)/1000e0,6) as total_sec, round(quantile_cont(s,0.5),6) as spread_median, round(quantile_cont(s,0.95),6) as spread_p95 from kinds group by 1,2,3,4""")
def latency_summary(spark, d):
    return rnd(rep.timing_summary(samples(spark, d), ["regime", "model", "target_tokens"], "rep_group"), *LAT)


@query("precision_ablation", COST_BASE + """, a as (select model, target_tokens, max(case when regime='nf4' then 1-(k1+e*k2)/k2 end) as red_nf4, max(case when regime='bf16' then 1-(k1+e*k2)/k2 end) as red_bf16,
  max(case when regime='nf4' then e end) as e_nf4, max(case when regime='bf16' then e end) as e_bf16 from pr join esc using (regime) group by 1,2)
  select model, target_tokens, round(e_nf4,6) as e_nf4, round(e_bf16,6) as e_bf16, round(red_nf4,6) as reduction_nf4, round(red_bf16,6) as reduction_bf16, round(red_bf16-red_nf4,6) as delta from a""")
def precision_ablation(spark, d):
    x = c.cascade_cost(pairs_with_e(spark, d)).groupBy("model", "target_tokens").pivot("regime", ["nf4", "bf16"]).agg(F.max("reduction").alias("reduction"), F.max("e").alias("e"))
    out = x.select("model", "target_tokens", F.col("nf4_e").alias("e_nf4"), F.col("bf16_e").alias("e_bf16"), F.col("nf4_reduction").alias("reduction_nf4"), F.col("bf16_reduction").alias("reduction_bf16"))
    return rnd(out.withColumn("delta", F.col("reduction_bf16") - F.col("reduction_nf4")), "e_nf4", "e_bf16", "reduction_nf4", "reduction_bf16", "delta")


@query("join_predictions_by_id", with_(SCORED) + "select 'ev-' || row_id as id, label, channel, case when source<>'src0' then p2 end as score, source<>'src0' as matched from scored")
def join_predictions_by_id(spark, d):
    s = scored(spark, d)
    ident = F.concat(F.lit("ev-"), F.col("row_id").cast("string"))
    preds = s.filter("source <> 'src0'").select(ident.alias("id"), F.col("p2").alias("score"))
    return s.select(ident.alias("id"), "label", "channel").join(preds, "id", "left").withColumn("matched", F.col("score").isNotNull())
