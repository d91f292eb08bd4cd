"""Registered metric queries (survey part 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.functions.scores import ratio, suspicion
from twinsieve.operators import metrics as m
from twinsieve.operators import reports as rep
from twinsieve.operators.ranks import quantiles, running
from twinsieve.plans.fixture_sql import SCORED, auroc_sql, dr_ctes, with_
from twinsieve.plans.registry import query
from twinsieve.sources.tables import scored, table

S = "scored"
SUS = "sus as (select *, 1e0-p1 as s1, 1e0-p2 as s2 from scored)"
LENGTH_BANDS = {"le_512": (0, 512), "513_2048": (513, 2048), "gt_2048": (2049, None)}
TOKEN_EDGES = (77, 128, 256, 512, 1024, 2048)


def suspicious(spark, d):
    return scored(spark, d).withColumn("s1", suspicion(F.col("p1"))).withColumn("s2", suspicion(F.col("p2")))


def rnd(c, *names):
    return c.select(*[F.round(F.col(x), 6).alias(x) if x in names else F.col(x) for x in c.columns])


@query("dist_counts", with_(SCORED) + """select case when grouping(channel)=0 then 'channel' when grouping(source)=0 then 'source'
  when grouping(label)=0 then 'label' else 'all' end as facet,
  coalesce(channel, source, label::varchar) as value, count(*)::bigint as n
  from scored group by grouping sets ((channel),(source),(label),())""")
def dist_counts(spark, d):
    s = scored(spark, d)
    g = s.groupingSets([[F.col("channel")], [F.col("source")], [F.col("label")], []], "channel", "source", "label")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.grouping("channel").alias("gc"), F.grouping("source").alias("gs"),
                F.grouping("label").alias("gl"))
    facet = F.when(F.col("gc") == 0, "channel").when(F.col("gs") == 0, "source").when(F.col("gl") == 0, "label").otherwise("all")
    return out.select(facet.alias("facet"), F.coalesce("channel", "source", F.col("label").cast("string")).alias("value"), "n")


CONF_SQL = """tp, fp, tn, fn, round(2*pr*rc/nullif(pr+rc,0),6) as f1, round(pr,6) as precision, round(rc,6) as recall, round(rc,6) as tpr,
  round(fp*1e0/nullif(fp+tn,0),6) as fpr, round((tp+tn)*1e0/nullif(tp+fp+tn+fn,0),6) as accuracy"""


def conf_ctes(src, pred, key):
    return f"""c as (select {key} as k, sum(case when {pred} and label=1 then 1 else 0 end)::bigint tp,
    sum(case when {pred} and label=0 then 1 else 0 end)::bigint fp, sum(case when not {pred} and label=0 then 1 else 0 end)::bigint tn,
    sum(case when not {pred} and label=1 then 1 else 0 end)::bigint fn from {src} group by 1),
  cc as (select *, tp*1e0/nullif(tp+fp,0) as pr, tp*1e0/nullif(tp+fn,0) as rc from c)"""


@query("confusion_metrics", with_(SCORED, SUS, conf_ctes("sus", "s2>0.5", "source")) + f"select k as source, {CONF_SQL} from cc")
def confusion_metrics(spark, d):
    s = suspicious(spark, d).withColumn("pred", (F.col("s2") > 0.5).cast("int"))
    return rnd(m.confusion(s, "pred", ["source"]), *m.CONFUSION)


@query("dr_at_fpr", with_(SCORED, SUS, *[dr_ctes("sus", "label", "s2", f"{t!r}e0", "source", f"d{i}") for i, t in enumerate(m.FPR_TARGETS)])
       + " union all ".join(f"""select k as source, {t!r}e0 as fpr_target, round(dr,6) as dr, threshold, round(achieved_fpr,6) as achieved_fpr,
       n_benign >= {int(1 / t)} as resolvable, n_benign, n_injection from d{i}_res""" for i, t in enumerate(m.FPR_TARGETS)))
def dr_at_fpr(spark, d):
    return rnd(m.dr_at_fpr(suspicious(spark, d), "s2", keys=["source"]), "dr", "achieved_fpr")


@query("thr_scan", with_(SCORED, SUS) + """, b as (select s2, count(*) over (order by s2 desc) as ge, count(*) over () as nb from sus where label=0),
 t as (select min(s2) as threshold from b where ge*1e0/nb <= 0.01e0)
 select threshold, round(sum(case when label=1 and s2>=threshold then 1 else 0 end)*1e0/sum(label),6) as dr,
 round(sum(case when label=0 and s2>=threshold then 1 else 0 end)*1e0/sum(1-label),6) as achieved_fpr from sus cross join t group by threshold""")
def thr_scan(spark, d):
    return rnd(m.thr_scan(suspicious(spark, d), "s2"), "dr", "achieved_fpr")


@query("thr_linear", with_(SCORED, SUS) + """, t as (select quantile_cont(s2, 0.99) as threshold from sus where label=0)
 select round(threshold,6) as threshold, round(sum(case when label=1 and s2>=threshold then 1 else 0 end)*1e0/sum(label),6) as dr,
 round(sum(case when label=0 and s2>=threshold then 1 else 0 end)*1e0/sum(1-label),6) as fpr from sus cross join t group by threshold""")
def thr_linear(spark, d):
    return rnd(m.thr_linear(suspicious(spark, d), "s2"), "threshold", "dr", "fpr")


BIN_SQL = "case when {c}<0 or {c}>1 then null else least(9, (select count(*) from range(1,10) r(i) where {c} >= i/10e0)) end"


def bins_cte(src, conf, key):
    terms = " + ".join(f"(case when {conf} >= {i / 10!r}e0 then 1 else 0 end)" for i in range(1, 10))
    return f"""bins as (select {key} as k, {terms} as bin, avg({conf}) as mean_conf, avg(label) as observed, count(*)::bigint as n
  from {src} where {conf} between 0 and 1 group by 1,2)"""


@query("ece", with_(SCORED, SUS, bins_cte("sus", "s2", "split")) + "select k as split, round(sum(n*abs(mean_conf-observed))/sum(n),6) as ece from bins group by k")
def ece(spark, d):
    return rnd(m.ece(suspicious(spark, d), "s2", ["split"]), "ece")


@query("reliability_bins", with_(SCORED, SUS, bins_cte("sus", "s1", "split")) +
       "select k as split, bin::int as bin, round(mean_conf,6) as mean_conf, round(observed,6) as observed, n from bins where n >= 5")
def reliability_bins(spark, d):
    b = m.reliability(suspicious(spark, d), "s1", ["split"]).filter(F.col("n") >= 5)
    return rnd(b, "mean_conf", "observed")


@query("auroc", with_(SCORED, SUS, auroc_sql("sus", "label", "s1", None, "a"), auroc_sql("sus", "label", "s2", None, "b")) +
       "select round(a_res.auroc,6) as auroc_stage1, round(b_res.auroc,6) as auroc_stage2 from a_res, b_res")
def auroc(spark, d):
    s = suspicious(spark, d)
    return rnd(m.one_row(m.auroc(s, "s1", name="auroc_stage1"), m.auroc(s, "s2", name="auroc_stage2")), "auroc_stage1", "auroc_stage2")


ROC_GROUPS = """g as (select 'all' as grp, s2, label from sus union all
  select c.ch, s.s2, s.label from sus s, (select distinct channel as ch from sus where channel is not null) c where s.label=0 or s.channel=c.ch)"""


def channel_vs_benign(s, channels=("document", "tool", "direct")):
    """Every row under 'all'; injections also under their channel, benign rows under each channel."""
    groups = F.when(F.col("label") == 0, F.array(F.lit("all"), *[F.lit(c) for c in channels])).otherwise(F.array(F.lit("all"), F.col("channel")))
    return s.withColumn("grp", F.explode(groups))


@query("roc_points", with_(SCORED, SUS, ROC_GROUPS) + """, t as (select grp, s2, sum(label) p, sum(1-label) q from g group by 1,2),
  r as (select grp, s2 as threshold, sum(p) over (partition by grp order by s2 desc)*1e0/sum(p) over (partition by grp) as tpr,
   sum(q) over (partition by grp order by s2 desc)*1e0/sum(q) over (partition by grp) as fpr from t)
  select grp, threshold, round(fpr,6) as fpr, round(tpr,6) as tpr, fpr between 1e-4 and 0.05 as low_fpr from r""")
def roc_points(spark, d):
    r = m.roc_points(channel_vs_benign(suspicious(spark, d)), "s2", ["grp"])
    return rnd(r.withColumn("low_fpr", F.col("fpr").between(1e-4, 0.05)), "fpr", "tpr")


@query("pr_average_precision", with_(SCORED, SUS) + """, t as (select s2, sum(label) p, count(*) c from sus group by 1),
  r as (select p*1e0/sum(p) over () as drc, sum(p) over (order by s2 desc)*1e0/sum(c) over (order by s2 desc) as pr from t)
  select round(sum(drc*pr),6) as average_precision, count(*)::bigint as n_thresholds, round((select avg(label) from sus),6) as prevalence from r""")
def pr_average_precision(spark, d):
    s = suspicious(spark, d)
    out = m.one_row(m.average_precision(s, "s2"), s.agg(F.avg("label").alias("prevalence")))
    return rnd(out, "average_precision", "prevalence")


def slices_sql(by):
    return f"""select '{by}' as slice_by, b.slice, b.n, b.pos, b.neg, round(b.accuracy,6) as accuracy, round({by[0]}_res.auroc,6) as auroc
 from (select coalesce({by},'None') as slice, count(*)::bigint n, sum(label)::bigint pos, sum(1-label)::bigint neg,
  avg(case when (s1>0.5)=(label=1) then 1 else 0 end) accuracy from sus group by 1) b left join {by[0]}_res on {by[0]}_res.k=b.slice"""


@query("slice_breakdown", with_(SCORED, SUS, auroc_sql("sus", "label", "s1", "coalesce(source,'None')", "s"),
                                auroc_sql("sus", "label", "s1", "coalesce(channel,'None')", "c")) + slices_sql("source") + " union all " + slices_sql("channel"))
def slice_breakdown(spark, d):
    s = suspicious(spark, d)
    out = m.slice_breakdown(s, "s1", "source").unionByName(m.slice_breakdown(s, "s1", "channel"))
    return rnd(out, "auroc", "accuracy")


GROUPED = "grouped as (select *, 'overall' as grp from sus union all select *, channel from sus where channel is not null)"


@query("per_channel", with_(SCORED, SUS, GROUPED, conf_ctes("grouped", "s2>0.5", "grp")) + f'select k as "group", {CONF_SQL} from cc')
def per_channel(spark, d):
    s = m.by_channel_and_overall(suspicious(spark, d)).withColumn("pred", (F.col("s2") > 0.5).cast("int"))
    return rnd(m.confusion(s, "pred", ["group"]), *m.CONFUSION)


DETECTOR = "llama3.2-1b"
RATES = [f"{c}_{rep.at_name(t)}" for c in ("dr", "thr") for t in m.FPR_TARGETS]
COST_COLS = ("n", "n_benign", "n_injection", "fpr_benign_only", "mean_latency_ms", "gpu_s_per_1k", "usd_per_1m", "param_count", "load_dtype", "vram_gb", "flops", "note")


@query("evaluate_detector", with_(SCORED, SUS, GROUPED, conf_ctes("grouped", "s2>0.5", "grp"), *[dr_ctes("sus", "label", "s2", f"{t!r}e0", None, f"d{i}") for i, t in enumerate(m.FPR_TARGETS)]) + f"""
  , o as (select count(*)::bigint as n, sum(1-label)::bigint as n_benign, sum(label)::bigint as n_injection, avg(case when label=0 then case when s2>0.5 then 1 else 0 end end) as f, avg(ms) as ms from sus)
  select k as "group", '{DETECTOR}' as detector, {CONF_SQL}, n, n_benign, n_injection, round(f,6) as fpr_benign_only, round(ms,6) as mean_latency_ms, round(ms,6) as gpu_s_per_1k, round(ms/1e3*1e6/3600e0*1.2e0,6) as usd_per_1m,
  case when o.n is not null then 1240000000 end::bigint as param_count, case when o.n is not null then 'bf16' end as load_dtype, case when o.n is not null then round(1240000000*2e0*1.2e0/1e9,6) end as vram_gb, case when o.n is not null then 2e0*1240000000*512 end as flops, null::varchar as note,
  {', '.join(f'round(dr{i},6) as dr_{rep.at_name(t)}, round(thr{i},6) as thr_{rep.at_name(t)}' for i, t in enumerate(m.FPR_TARGETS))}
  from cc left join o on k='overall' left join (select {', '.join(f'd{i}_res.dr as dr{i}, d{i}_res.threshold as thr{i}' for i in range(3))} from d0_res, d1_res, d2_res) r on k='overall'""")
def evaluate_detector(spark, d):
    s = suspicious(spark, d).withColumn("pred", (F.col("s2") > 0.5).cast("int"))
    out = rep.evaluate_detector(s, DETECTOR, "pred", "s2", "ms").select("group", "detector", "tp", "fp", "tn", "fn", *m.CONFUSION, *COST_COLS, *RATES)
    return rnd(out, *m.CONFUSION, *RATES, "fpr_benign_only", "mean_latency_ms", "gpu_s_per_1k", "usd_per_1m", "vram_gb")


def selection_frame(s, score):
    pred = s.withColumn("pred", (F.col(score) > 0.5).cast("int"))
    conf = m.confusion(pred, "pred", ["split"]).select("split", "f1", "precision", "recall", "fpr", "accuracy",
                                                      (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"))
    return (conf.join(m.auroc(s, score, ["split"]), "split").join(m.ece(s, score, ["split"]), "split")
            .join(m.dr_column(s, score, 0.01, ["split"]), "split"))


def selection_ctes(score, tag):
    terms = " + ".join(f"(case when {score} >= {i / 10!r}e0 then 1 else 0 end)" for i in range(1, 10))
    return [auroc_sql("sus", "label", score, "split", f"{tag}a"), dr_ctes("sus", "label", score, "0.01e0", "split", f"{tag}d"),
            f"""{tag}b as (select split as k, {terms} as bin, avg({score}) mc, avg(label) ob, count(*) n from sus group by 1,2)""",
            f"""{tag}e as (select k, sum(n*abs(mc-ob))/sum(n) as ece from {tag}b group by k)""",
            f"""{tag}c as (select split as k, count(*)::bigint n, sum(case when {score}>0.5 and label=1 then 1 else 0 end) tp,
    sum(case when {score}>0.5 and label=0 then 1 else 0 end) fp, sum(case when {score}<=0.5 and label=0 then 1 else 0 end) tn,
    sum(case when {score}<=0.5 and label=1 then 1 else 0 end) fn from sus group by 1)""",
            f"""{tag}m as (select {tag}c.k as split, n, tp*2e0/nullif(2*tp+fp+fn,0) as f1, tp*1e0/nullif(tp+fp,0) as precision, tp*1e0/nullif(tp+fn,0) as recall,
    fp*1e0/nullif(fp+tn,0) as fpr, (tp+tn)*1e0/n as accuracy, auroc, ece, dr from {tag}c join {tag}a_res using (k) join {tag}e using (k) join {tag}d_res using (k))"""]


SEL_COLS = ("f1", "precision", "recall", "fpr", "accuracy", "auroc", "ece", "dr")


ALL_DR = [f"dr_{rep.at_name(t)}" for t in m.FPR_TARGETS]
SLICE_NULLS = ", ".join(f"null::double as {c}" for c in ("f1", "precision", "recall", "fpr", "ece", *ALL_DR))


def split_slices_sql(by, tag):
    return f"""select b.split, '{by}' as slice_by, b.slice, b.n, b.neg as n_benign, b.pos as n_injection, round(b.accuracy,6) as accuracy, round({tag}_res.auroc,6) as auroc, {SLICE_NULLS}
 from (select split, coalesce({by},'None') as slice, count(*)::bigint n, sum(label)::bigint pos, sum(1-label)::bigint neg, avg(case when (s1>0.5)=(label=1) then 1 else 0 end) accuracy from sus group by 1,2) b
 left join {tag}_res on {tag}_res.k = b.split || '/' || b.slice"""


@query("selection_metrics", with_(SCORED, SUS, *selection_ctes("s1", "x"), *[dr_ctes("sus", "label", "s1", f"{t!r}e0", "split", f"z{i}") for i, t in enumerate(m.FPR_TARGETS)],
                                  auroc_sql("sus", "label", "s1", "split || '/' || coalesce(source,'None')", "us"), auroc_sql("sus", "label", "s1", "split || '/' || coalesce(channel,'None')", "uc"))
       + """select split, 'all' as slice_by, 'all' as slice, n, z0_res.n_benign, z0_res.n_injection, round(accuracy,6) as accuracy, round(auroc,6) as auroc, round(f1,6) as f1, round(precision,6) as precision, round(recall,6) as recall, round(fpr,6) as fpr, round(ece,6) as ece, """
       + ", ".join(f"round(z{i}_res.dr,6) as {c}" for i, c in enumerate(ALL_DR)) + " from xm " + " ".join(f"join z{i}_res on z{i}_res.k=split" for i in range(3))
       + " union all by name " + split_slices_sql("source", "us") + " union all by name " + split_slices_sql("channel", "uc"))
def selection_metrics(spark, d):
    s = suspicious(spark, d)
    sizes = s.groupBy("split").agg(F.sum(1 - F.col("label")).alias("n_benign"), F.sum("label").alias("n_injection"))
    whole = selection_frame(s, "s1").drop("dr").join(sizes, "split").join(rep.rates_at(s, "s1", m.FPR_TARGETS, ["split"]).select("split", *ALL_DR), "split")
    whole = whole.withColumns({"slice_by": F.lit("all"), "slice": F.lit("all")})
    for by in ("source", "channel"):
        part = m.slice_breakdown(s, "s1", by, ["split"]).withColumnsRenamed({"pos": "n_injection", "neg": "n_benign"})
        whole = whole.unionByName(part, allowMissingColumns=True)
    return rnd(whole, *SEL_COLS, *ALL_DR)


@query("rank_candidates", with_(SCORED, SUS, *selection_ctes("s1", "x"), *selection_ctes("s2", "y")) + """, u as (
  select 'stage1' as name, dr, ece, auroc from xm where split='val' union all select 'stage2', dr, ece, auroc from ym where split='val')
  select name, round(dr,4) as val_dr, round(ece,4) as val_ece, round(auroc,4) as val_auroc,
  row_number() over (order by round(dr,4) desc, round(ece,4), name)::bigint as place,
  row_number() over (order by round(dr,4) desc, round(ece,4), name)=1 as winner from u""")
def rank_candidates(spark, d):
    s = suspicious(spark, d).filter(F.col("split") == "val")
    # One row per candidate detector: the ranking window sees as many rows as there are detectors.
    rows = None
    for name, score in (("stage1", "s1"), ("stage2", "s2")):
        f = selection_frame(s, score).select(F.lit(name).alias("name"), F.round("dr", 4).alias("val_dr"),
                                             F.round("ece", 4).alias("val_ece"), F.round("auroc", 4).alias("val_auroc"))
        rows = f if rows is None else rows.unionByName(f)
    place = F.row_number().over(m.Window.partitionBy(F.lit(0)).orderBy(F.desc("val_dr"), "val_ece", "name")).cast("long")
    return rows.withColumn("place", place).withColumn("winner", F.col("place") == 1)


@query("spearman_len", with_(SCORED, SUS) + """, r as (select rank() over (order by s1) + (count(*) over (partition by s1)-1)/2e0 as a,
  rank() over (order by n_tokens) + (count(*) over (partition by n_tokens)-1)/2e0 as b from sus where label=0)
  select round(corr(a,b),6) as spearman from r""")
def spearman_len(spark, d):
    return rnd(m.spearman(suspicious(spark, d).filter("label = 0"), "s1", "n_tokens"), "spearman")


BANDED = "banded as (select *, case when n_tokens<=512 then 'le_512' when n_tokens<=2048 then '513_2048' else 'gt_2048' end as band from sus)"


@query("length_bands", with_(SCORED, SUS, BANDED, auroc_sql("banded", "label", "s2", "band"), dr_ctes("banded", "label", "s2", "0.01e0", "band")) + """
  select b.band, b.n, b.n_injection, round(auroc,6) as auroc, round(dr,6) as dr from (select band, count(*)::bigint n, sum(label)::bigint n_injection
  from banded group by 1) b join a_res on a_res.k=band join d_res on d_res.k=band""")
def length_bands(spark, d):
    return rnd(m.length_bands(suspicious(spark, d), "s2", "n_tokens", LENGTH_BANDS), "auroc", "dr")


@query("quantile_stats", """with l as (select source, length(text)::bigint as n from documents)
  select source, count(*)::bigint as rows, quantile_cont(n,0.5)::double::decimal(18,4)//1::bigint as len_p50, 0 as x from l group by source""")
def quantile_stats(spark, d):
    n = F.col("n")
    rows = table(spark, d, "documents").select("source", F.length("text").cast("long").alias("n"))
    bucket = {"lt_200": n < 200, "b200_500": (n >= 200) & (n < 500), "b500_1k": (n >= 500) & (n < 1000),
              "b1k_2k": (n >= 1000) & (n < 2000), "b2k_5k": (n >= 2000) & (n < 5000), "ge_5k": n >= 5000}
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("len_max"),
                                        *[F.count(F.when(c, 1)).alias(k) for k, c in bucket.items()])
    q = quantiles(rows, "n", {"len_p50": 0.5, "len_p90": 0.9, "len_p99": 0.99}, ["source"])
    q = q.select("source", *[F.floor(F.round(F.col(c), 6)).cast("long").alias(c) for c in ("len_p50", "len_p90", "len_p99")])
    return counts.join(q, "source")


from twinsieve.plans.registry import ORACLES  # noqa: E402

ORACLES["quantile_stats"] = """with l as (select source, length(text)::bigint as n from documents)
  select source, count(*)::bigint as "rows", max(n) as len_max, count(*) filter (n<200)::bigint as lt_200, count(*) filter (n>=200 and n<500)::bigint as b200_500,
  count(*) filter (n>=500 and n<1000)::bigint as b500_1k, count(*) filter (n>=1000 and n<2000)::bigint as b1k_2k,
  count(*) filter (n>=2000 and n<5000)::bigint as b2k_5k, count(*) filter (n>=5000)::bigint as ge_5k,
  floor(round(quantile_cont(n::double,0.5),6))::bigint as len_p50, floor(round(quantile_cont(n::double,0.9),6))::bigint as len_p90,
  floor(round(quantile_cont(n::double,0.99),6))::bigint as len_p99 from l group by source"""

BAND_TERMS = " + ".join(f"(case when n_tokens > {e} then 1 else 0 end)" for e in TOKEN_EDGES)


@query("length_profile", with_(SCORED) + f""", b as (select split, ({BAND_TERMS})::int as band, count(*)::bigint n from scored group by 1,2),
  q as (select split, avg(n_tokens) mean_tokens, quantile_cont(n_tokens::double,0.5) median_tokens, avg(case when n_tokens>=512 then 1 else 0 end) ge_512 from scored group by 1)
  select split, band, n, round(n*1e0/sum(n) over (partition by split),6) as share, round(sum(n) over (partition by split order by band)*1e0/sum(n) over (partition by split),6) as ecdf,
  round(mean_tokens,6) as mean_tokens, round(median_tokens,6) as median_tokens, round(ge_512,6) as ge_512 from b join q using (split)""")
def length_profile(spark, d):
    s = scored(spark, d)
    n = F.col("n_tokens")
    band = sum(((n > e).cast("int") for e in TOKEN_EDGES), F.lit(0))
    counts = s.groupBy("split", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    w = m.Window.partitionBy("split")
    counts = counts.select("split", "band", "n", (F.col("n") / F.sum("n").over(w)).alias("share"),
                           (F.sum("n").over(w.orderBy("band")) / F.sum("n").over(w)).alias("ecdf"))
    stats = s.groupBy("split").agg(F.avg("n_tokens").alias("mean_tokens"), F.avg((n >= 512).cast("int")).alias("ge_512"))
    out = counts.join(stats, "split").join(quantiles(s, "n_tokens", {"median_tokens": 0.5}, ["split"]), "split")
    return rnd(out, "share", "ecdf", "mean_tokens", "median_tokens", "ge_512")


@query("fpr_by_length_quartile", with_(SCORED, SUS) + """, q as (select quantile_cont(n_tokens::double,0.25) a, quantile_cont(n_tokens::double,0.5) b,
  quantile_cont(n_tokens::double,0.75) c from sus where label=0),
  r as (select case when n_tokens<a then 'q1' when n_tokens<b then 'q2' when n_tokens<c then 'q3' else 'q4' end as quartile, a, b, c, s1 from sus, q where label=0)
  select quartile, count(*)::bigint as n, round(avg(case when s1>0.5 then 1 else 0 end),6) as fpr, floor(max(a))::bigint as edge1,
  floor(max(b))::bigint as edge2, floor(max(c))::bigint as edge3 from r group by 1""")
def fpr_by_length_quartile(spark, d):
    s = suspicious(spark, d).filter("label = 0")
    cuts = quantiles(s, "n_tokens", {"a": 0.25, "b": 0.5, "c": 0.75})
    n = F.col("n_tokens")
    quartile = F.when(n < F.col("a"), "q1").when(n < F.col("b"), "q2").when(n < F.col("c"), "q3").otherwise("q4")
    out = s.join(F.broadcast(cuts)).groupBy(quartile.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("s1") > 0.5).cast("int")).alias("fpr"),
        *[F.floor(F.max(c)).alias(e) for c, e in (("a", "edge1"), ("b", "edge2"), ("c", "edge3"))])
    return rnd(out, "fpr")


@query("survival_benign", with_(SCORED, SUS) + """select split, s2 as score, count(*)::bigint as n,
  round(sum(count(*)) over (partition by split order by s2 desc)*1e0/sum(count(*)) over (partition by split),6) as survival from sus where label=0 group by 1,2""")
def survival_benign(spark, d):
    return rnd(m.survival_benign(suspicious(spark, d), "s2", ["split"]), "survival")


HIST_TERMS = " + ".join(f"(case when s2 >= {i / 50!r}e0 then 1 else 0 end)" for i in range(1, 50))


@query("histogram_density", with_(SCORED, SUS) + f""", h as (select case when p1<0.7 then 'escalated' else 'passed' end as side, ({HIST_TERMS})::int as bin, count(*)::bigint n
  from sus where label=1 group by 1,2) select side, bin, n, round(n*50e0/sum(n) over (partition by side),6) as density from h""")
def histogram_density(spark, d):
    a = suspicious(spark, d).filter("label = 1").withColumn("side", F.when(F.col("p1") < 0.7, "escalated").otherwise("passed"))
    return rnd(m.histogram_density(a, "s2", ["side"]), "density")
