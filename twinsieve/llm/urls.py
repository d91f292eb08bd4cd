"""URL filters: explicit rules, and path templates learnt per host."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import lookup, stored

DEPTH = 4
MIN_ROWS, MIN_SHARE = 10, 0.01  # of a literal segment at its node
Z, SAME = 2.326, 0.02  # 1% test; information per row (nats) below which branches count as alike
PRIOR, BLOCK_ABOVE = 5.0, 0.8


class Rule(NamedTuple):
    allow: bool
    host: str
    path: str


#: Host and path prefixes with a fixed verdict. Fixed values.
RULES = (Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"), Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host or a subdomain of it and whose path prefix fit; null if none."""
    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("text"), F.lit(r.allow).alias("allow"))) for r in ordered])


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with numbers and long hex strings as wildcards; what is below ``depth`` becomes one."""
    raw = F.split(F.regexp_replace(path, "^/", ""), "/")
    general = F.transform(F.slice(raw, 1, depth), lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), "<hex>").otherwise(F.regexp_replace(s, "[0-9]+", "<num>")))
    return F.when(F.size(raw) > depth, F.concat(F.slice(general, 1, depth - 1), F.array(F.lit("**")))).otherwise(general)


def _critical(dof: Column) -> Column:
    """Chi-square quantile for Z by the cube-root approximation."""
    c = 2.0 / (9.0 * dof)
    return F.when(dof > 0, dof * F.pow(1.0 - c + Z * F.sqrt(c), F.lit(3.0))).otherwise(0.0)


def _alike(own: Column, pool: Column, cells: Sequence[tuple[Column, Column]], dof: Column) -> Column:
    """G-test of a branch's counts against its siblings' pooled counts; also alike when the information is tiny."""
    g = reduce(lambda a, b: a + b, [F.when(n > 0, n * F.log(n * pool / (own * m))).otherwise(0.0) for n, m in cells])
    return (own == 0) | (2 * g <= _critical(dof) + 1e-9) | (g <= SAME * own)


def literal_segments(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Top down: a segment that is rare at its node becomes ``*``. Adds ``t1`` to ``t<depth>`` (empty past the end)."""
    rows = rows.withColumn("_prefix", F.lit(""))
    for d in range(1, depth + 1):
        rows = rows.withColumn("_seg", F.coalesce(F.get("segs", F.lit(d - 1)), F.lit("")))
        at = stored(rows.groupBy("host", "_prefix", "_seg").agg(F.count("*").alias("n")), "url-counts")
        totals = stored(at.groupBy("host", "_prefix").agg(F.sum("n").alias("total")), "url-totals")
        often = lookup(at.filter(F.col("n") >= MIN_ROWS), totals, ["host", "_prefix"], F.col("_seg"))
        often = stored(often.filter(F.col("n") >= MIN_SHARE * F.col("total")).select("host", "_prefix", "_seg", F.lit(True).alias("_often")), "url-literals")
        rows = lookup(rows, often, ["host", "_prefix", "_seg"], F.col("url_no"))
        fixed = F.col("_often") | (F.col("_seg") == "") | F.col("_seg").rlike("^<[a-z]+>(\\.[a-z]+)?$")
        rows = rows.withColumn(f"t{d}", F.when(fixed, F.col("_seg")).otherwise("*"))
        rows = stored(rows.withColumn("_prefix", F.concat("_prefix", F.lit("/"), F.col(f"t{d}"))).drop("_often", "_seg"), "url-rows")
    return rows


def merged_branches(templates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Bottom up: siblings whose paths below and whose labels agree with their pool become one branch ``*``.

    ``templates``: ``host, o1.., t1.., n, good, bad``; the ``t`` columns are rewritten. There are as many rows as
    templates, at most 1 / MIN_SHARE literals at a node.
    """
    ts = [f"t{d}" for d in range(1, depth + 1)]
    for d in range(depth, 0, -1):
        parent = ["host", *ts[: d - 1]]
        below = F.concat_ws("/", F.lit(""), *ts[d:])
        t = templates.withColumn("_below", below)
        cell = t.groupBy(*parent, ts[d - 1], "_below").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        over = lambda *more: Window.partitionBy(*parent, *more)
        cell = cell.select("*", F.sum("n").over(over("_below")).alias("_m"))
        branch = cell.groupBy(*parent, ts[d - 1]).agg(
            F.sum("n").alias("own"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.log(F.col("n") / F.col("_m"))).alias("_g"))
        dof = cell.groupBy(*parent).agg((F.countDistinct("_below") - 1).alias("dof"))
        branch = branch.join(dof, parent).select(
            *parent, ts[d - 1], "own", "good", "bad", "_g", "dof", *[F.sum(c).over(over()).alias(f"_{c}s") for c in ("own", "good", "bad")], F.count("*").over(over()).alias("_k"))
        g = F.col("_g") + F.col("own") * F.log(F.col("_owns") / F.col("own"))
        shape = (2 * g <= _critical(F.col("dof")) + 1e-9) | (g <= SAME * F.col("own"))
        labels = _alike(F.col("good") + F.col("bad"), F.col("_goods") + F.col("_bads"), [(F.col("good"), F.col("_goods")), (F.col("bad"), F.col("_bads"))], F.lit(1.0))
        join = [*parent, ts[d - 1]]
        alike = branch.filter((F.col("_k") > 1) & shape & labels & (F.col(ts[d - 1]) != "")).select(*join, F.lit(True).alias("_alike"))
        templates = stored(templates.join(alike, join, "left").withColumn(ts[d - 1], F.when(F.col("_alike"), "*").otherwise(F.col(ts[d - 1]))).drop("_alike"), "url-templates")
    return templates


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, depth: int = DEPTH) -> DataFrame:
    """Rule and verdict of every url.

    The longest fitting rule decides. Where none fits, the url's template does: per host, a tree of path segments
    in which numbers, hex strings and rare segments are wildcards and similar branches are merged. The rules'
    verdicts are the labels of the urls they cover. A template is blocked if its share of blocked labels, smoothed
    towards its host's share and that towards the share of all labels, passes ``BLOCK_ABOVE``; without labels it
    stays open.

    Counts are summed before they move; a host that holds a third of all urls is spread over its segments and, in
    lookups, over salts. Only ``page_id`` and ``url`` are read.

    Returns ``page_id, host, path, rule, verdict, template, purity`` (share blocked). A null url or one without
    ``://`` has an empty host and path; repeated rows and null ids stay as they are; an empty table gives an empty
    result; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.allow").alias("allow"), segments(F.col("path"), depth).alias("segs"),
        F.monotonically_increasing_id().alias("url_no"))
    rows = literal_segments(stored(rows, "urls"), depth)
    ts = [f"t{d}" for d in range(1, depth + 1)]
    templates = rows.groupBy("host", *ts).agg(F.count("*").alias("n"), F.count_if("allow").alias("good"), F.count_if(~F.col("allow")).alias("bad"))
    templates = stored(templates.select("*", *[F.col(t).alias(f"o{t[1:]}") for t in ts]), "url-templates")
    templates = merged_branches(templates, depth)
    # shares: template towards host towards all
    overall = templates.agg((F.sum("bad") / F.nullif(F.sum("good") + F.sum("bad"), F.lit(0))).alias("_p"))
    host = templates.groupBy("host").agg(F.sum("good").alias("_hg"), F.sum("bad").alias("_hb"))
    one = templates.groupBy("host", *ts).agg(F.sum("good").alias("_tg"), F.sum("bad").alias("_tb"))
    smooth = lambda bad, good, towards: (bad + PRIOR * towards) / (bad + good + PRIOR)
    p_all = F.coalesce(F.col("_p"), F.lit(0.0))
    p_host = smooth(F.col("_hb"), F.col("_hg"), p_all)
    scored = one.join(host, "host").crossJoin(F.broadcast(overall)).select("host", *ts, smooth(F.col("_tb"), F.col("_tg"), p_host).alias("purity"))
    scored = templates.join(scored, ["host", *ts]).select("host", *[F.col(f"o{t[1:]}").alias(t) for t in ts], F.rtrim(F.concat_ws("/", F.lit(""), *ts), F.lit("/")).alias("template"), F.round("purity", 9).alias("purity"))
    out = lookup(rows, stored(scored, "url-scores"), ["host", *ts], F.col("url_no"))
    own = F.when(F.col("purity") > BLOCK_ABOVE, "block").otherwise("allow")
    verdict = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block").otherwise(own)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
