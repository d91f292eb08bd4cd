"""Registered streaming and user-code queries (survey parts 2.9 and 2.10)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from twinsieve.functions.scores import ratio
from twinsieve.operators import plugins
from twinsieve.operators.aggregates import ScoreHistogram, aggregate_by
from twinsieve.operators.metrics import by_channel_and_overall
from twinsieve.plans.fixture_sql import SCORED, auroc_sql, with_
from twinsieve.plans.metrics import GROUPED, SUS, rnd, suspicious
from twinsieve.plans.registry import query
from twinsieve.sources.readers import scratch
from twinsieve.sources.tables import scored, table
from twinsieve.streaming.route import DECISIONS, read_sinks, run_available, run_sinks


@query("route_stream", with_(SCORED) + """, c as (select row_id, 1e0/(1e0+exp(-(ln(p1)-ln(1e0-p1))/2e0)) as p from scored)
  select row_id, round(p,6) as p_safe, case when p>=0.6e0 then 'pass' when p<=0.4e0 then 'block' else 'escalate' end as decision from c""")
def route_stream(spark, d):
    arrived, out, state = (scratch(spark, x) for x in ("arrived", "routed", "routed-state"))
    s = scored(spark, d)
    s.select("row_id", F.log("p1").alias("logp_benign"), F.log(1.0 - F.col("p1")).alias("logp_injection")).repartition(4).write.parquet(arrived)
    run_available(spark, arrived, out, state, 2.0, 0.6, 0.4, files_per_batch=2)
    back = spark.read.schema("row_id bigint, p_safe double, decision string").parquet(out)
    return rnd(back.select("row_id", "p_safe", "decision"), "p_safe")


@query("route_sinks", with_(SCORED) + """, c as (select row_id, 1e0/(1e0+exp(-(ln(p1)-ln(1e0-p1))/2e0)) as p from scored)
  select row_id, round(p,6) as p_safe, case when p>=0.6e0 then 'pass' when p<=0.4e0 then 'block' else 'escalate' end as decision from c""")
def route_sinks(spark, d):
    """Every request arrives, and every third one twice; each is routed once, to the sink of its decision."""
    arrived, out, state = (scratch(spark, x) for x in ("requests", "sinks", "sinks-state"))
    s = scored(spark, d).select("row_id", F.log("p1").alias("logp_benign"), F.log(1.0 - F.col("p1")).alias("logp_injection"),
                                F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("row_id", F.lit(300))).alias("sent"))
    s.unionByName(s.filter("row_id % 3 = 0")).repartition(4).write.parquet(arrived)
    sinks = {x: f"{out}/{x}" for x in DECISIONS}
    run_sinks(spark, arrived, sinks, state, 2.0, 0.6, 0.4, files_per_batch=2)
    return rnd(read_sinks(spark, sinks), "p_safe")


def flag_sums(rows):
    """Partial sums of a user metric: row count, flagged rows, and their suspicion."""
    hit = rows["s2"] > 0.5
    return {"n": float(len(rows)), "flagged": float(hit.sum()), "mass": float(rows["s2"][hit].sum())}


@query("metric_callable", with_(SCORED, SUS, GROUPED) + """select grp as "group", round(avg(case when s2>0.5 then 1e0 else 0 end),6) as flag_rate, round(avg(case when s2>0.5 then s2 end),6) as mean_flagged from grouped group by 1""")
def metric_callable(spark, d):
    rows = by_channel_and_overall(suspicious(spark, d)).select("group", "s2")
    finish = {"flag_rate": ratio(F.col("flagged"), F.col("n")), "mean_flagged": ratio(F.col("mass"), F.col("flagged"))}
    return rnd(plugins.metric_by(rows, "group", flag_sums, ["n", "flagged", "mass"], finish), "flag_rate", "mean_flagged")


@query("metric_mergeable", with_(SCORED, "binned as (select source, label, floor((1e0-p2)*1000e0)/1000e0 as s from scored)", auroc_sql("binned", "label", "s", "source"),
                                "med as (select source, s, row_number() over (partition by source order by s) as i, count(*) over (partition by source) as n from binned)")
       + "select source, round(max(case when i=(n+1)//2 then s end),6) as median, round(max(auroc),6) as auroc from med join a_res on k=source group by 1")
def metric_mergeable(spark, d):
    """Metrics that are not sums: median and AUROC of a slice from merged histograms of the user's own."""
    rows = suspicious(spark, d).select("source", "label", (F.floor(F.col("s2") * 1000.0) / 1000.0).alias("s"))
    return rnd(aggregate_by(rows, "source", ScoreHistogram("s", "label"), ["median", "auroc"]), "median", "auroc")


def make_space_scorer():
    """A stand-in model: texts with many spaces for their length look suspicious."""

    def score(texts):
        out = []
        for x in texts:
            p = (len(x) + 1) / (len(x) + 7 * x.count(" ") + 2)
            out.append((math.log(p), math.log(1.0 - p)))
        return out

    return score


@query("score_split", """with p as (select doc_id, (length(text)+1e0)/(length(text) + 7*(length(text)-length(replace(text,' ',''))) + 2e0) as p from documents)
  select doc_id, round(ln(p),6) as logp_benign, round(ln(1e0-p),6) as logp_injection, round(p,6) as p_safe from p""")
def score_split(spark, d):
    out = plugins.score_texts(table(spark, d, "documents"), "doc_id", "text", make_space_scorer)
    return rnd(out, "logp_benign", "logp_injection", "p_safe")
