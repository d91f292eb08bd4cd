"""Secret scans: fixed patterns, and weak candidates that only count where their other parts are near."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import stored, text_of


class Kind(NamedTuple):
    """``test`` says of a match whether it counts; a failing match still uses up its text."""

    name: str
    pattern: str
    role: str  # id, secret or endpoint
    weak: bool
    test: tuple[str, ...] = ()


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Kinds in the order of their listing. Patterns are fixed values.
KINDS = (
    Kind("assign", _ASSIGN, "secret", False, (r"^" + _ASSIGN.replace("+/_.=-]+)", "+/_.=-]{8,})") + r"$",)),
    Kind("access", r"AKIA[A-Z0-9]+", "id", False, (r"^.{16,}$",)),
    Kind("hex", r"[0-9a-f]{32,}", "secret", False),
    Kind("weak_id", r"""(?i:user(?:name)?|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "id", True),
    Kind("weak_endpoint", r"""(?:https?|wss?|ftp|s3|amqps?|rediss?|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D"'<>]+""", "endpoint", True),
    Kind("weak_secret", r"[A-Za-z0-9+/_-]{20,}", "secret", True, (r"[0-9]", r"[A-Z]", r"[a-z]")),
)

NEAR = 300  # code points between the parts of one credential


def _found(t: Column, kind: Kind) -> Column:
    """Gap before, length and verdict of every match; texts without one, the most, are passed over once."""
    gaps = F.split(t, kind.pattern, -1)
    ok = F.lit(True)
    matches = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))
    kinds = "array<struct<gap:int,len:int,ok:boolean>>"

    def one(pair: Column) -> Column:
        verdict = ok
        for test in kind.test:
            verdict = verdict & pair["m"].rlike(test)
        return F.struct(F.length(pair["g"]).alias("gap"), F.length(pair["m"]).alias("len"), verdict.alias("ok"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(0))).alias("g"), matches.alias("m"))
    return F.when(t.rlike(kind.pattern), F.transform(zipped, one)).otherwise(F.array().cast(kinds)).cast(kinds)


def _places(scanned: DataFrame) -> DataFrame:
    """One row per counting match: ``row_no, kind, start, end``. Places are running sums of gaps and lengths."""
    each = None
    for n, kind in enumerate(KINDS):
        part = scanned.select("row_no", F.lit(n).alias("kind"), F.posexplode(kind.name).alias("nth", "m")).select("row_no", "kind", "nth", "m.*")
        each = part if each is None else each.unionByName(part)
    run = Window.partitionBy("row_no", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(run)
    return each.select("row_no", "kind", "ok", end.alias("end"), (end - F.col("len")).alias("start")).filter("ok").drop("ok")


def _linked(places: DataFrame) -> DataFrame:
    """Adds ``keep``: all base spans, and weak ones whose complementary parts lie within NEAR of them."""
    is_kind = lambda *names: F.col("kind").isin([n for n, k in enumerate(KINDS) if k.name in names])
    role = lambda r: F.col("kind").isin([n for n, k in enumerate(KINDS) if k.role == r])
    base = ~F.col("kind").isin([n for n, k in enumerate(KINDS) if k.weak])
    order = Window.partitionBy("row_no").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    last = lambda c: F.max(F.when(c, F.col("end"))).over(before)
    following = lambda c: F.min(F.when(c, F.col("start"))).over(after)
    near = lambda c: F.coalesce(F.col("start") - last(c) <= NEAR, F.lit(False)) | F.coalesce(following(c) - F.col("end") <= NEAR, F.lit(False))
    hit = lambda c: F.coalesce(last(c) > F.col("start"), F.lit(False)) | F.coalesce(following(c) < F.col("end"), F.lit(False))
    with_id, with_secret = near(role("id")), near(role("secret"))
    weak = (
        F.when(is_kind("weak_id"), with_secret & ~hit(base))
        .when(is_kind("weak_endpoint"), with_id & with_secret & ~hit(base | is_kind("weak_id")))
        .otherwise(with_id & ~hit(base | is_kind("weak_id", "weak_endpoint")))
    )
    return places.withColumn("keep", base | weak)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every document as spans of code points, end exclusive.

    Base kinds count by themselves. Identifiers (``weak_id``), long mixed tokens (``weak_secret``) and service
    addresses (``weak_endpoint``) count only as parts of one credential: an identifier needs a secret, a secret an
    identifier and an address both, at most NEAR code points away, base spans included. A weak span that overlaps
    a base span, or a weak one listed before it, is left out.

    Texts are read once and stay in their task; only matches move. The nearest part on either side decides, so a
    text full of candidates costs a sort and no pairs.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak``: ``spans`` is ``kind:start:end`` of
    all, by start, then kind as listed, comma-joined, and ``base_sha256`` the digest of the base ones joined alike.
    A null text is empty; rows are scanned one by one, so repeated rows and null ids stay; an empty table gives
    an empty result; other columns are ignored.
    """
    t = text_of()
    scanned = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), *[_found(t, k).alias(k.name) for k in KINDS]), "secrets")
    kept = _linked(_places(scanned)).filter("keep")
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    label = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct("start", "kind", label.alias("label"))
    base = ~F.col("kind").isin([n for n, k in enumerate(KINDS) if k.weak])
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, entry))), lambda e: e["label"]), ",")
    number = lambda n: F.count_if(F.col("kind") == n)
    per_row = kept.groupBy("row_no").agg(
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.count_if(~base).alias("n_weak"),
        listed(base).alias("_base"), listed(F.lit(True)).alias("spans"))
    none = {"n_assign": F.lit(0), "n_access": F.lit(0), "n_hex": F.lit(0), "n_weak": F.lit(0), "_base": F.lit(""), "spans": F.lit("")}
    out = scanned.select("doc_id", "row_no").join(per_row, "row_no", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("_base", 256).alias("base_sha256"), "spans", "n_weak").withColumns(
        {c: F.col(c).cast("long") for c in ("n_assign", "n_access", "n_hex", "n_weak")})
