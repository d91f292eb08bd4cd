"""Corpus building: validation, variants, deduplication, splitting and balanced sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions.hashing import fraction, order_key, pick
from twinsieve.operators.ranks import number_by_hash, number_by_value, running
from twinsieve.sources.readers import stored

TRIPLE_STEP = 1500450271  # prime


def validated(df: DataFrame, text: str, label: str, channel: str, labels: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Strip, drop texts under five characters, and stop on a label or channel outside its vocabulary."""
    bad = ~F.col(label).isin(*labels) | ~F.col(channel).isin(*channels)
    body = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("label or channel outside the vocabulary")).cast("string"))
    body = body.otherwise(t.strip(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn(text, body).filter(F.length(text) >= 5)


def first_rows(df: DataFrame, key: str, order: Sequence[str], cap: int) -> DataFrame:
    """First ``cap`` rows of every key in order. Spark applies the limit before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).withColumn("rn", F.col("rn").cast("long"))


def dedup_exact(df: DataFrame, text: str, order: str, *extra: str) -> DataFrame:
    """First row per normalised text (and per any extra key) in the order of a column, nulls last.

    The whole first row is kept per digest, with map-side combine: a group of copies of any size leaves a task as one
    row, and a text moves once. The order column decides nothing else: rows without a value in it and rows
    that share one are rows like any others. Of rows of one place the first by text, then by the other columns
    stays, so the result does not depend on the layout. A null text is a text of its own.
    """
    plain = [f.name for f in df.schema.fields if f.name not in (order, text) and f.dataType.typeName() not in ("map", "variant")]
    place = F.struct(F.col(order).isNull(), F.col(order), F.col(text), *plain)
    key = F.md5(t.norm_exact(F.col(text)).cast("binary"))
    first = df.groupBy(*[F.col(e).alias(f"_k{i}") for i, e in enumerate(extra)], key.alias("_key")).agg(F.min_by(F.struct(*df.columns), place).alias("_row"))
    return first.select("_row.*")


def with_variants(df: DataFrame, text: str, chosen: Column) -> DataFrame:
    """Originals plus three encoded rows for each chosen one, all under the same ``group_id``."""
    body = F.col(text)
    plain = F.struct(F.lit("original").alias("variant"), body.alias("body"))
    coded = [
        F.struct(F.lit("b64").alias("variant"), t.base64_text(body).alias("body")),
        F.struct(F.lit("rot13").alias("variant"), t.rot13(body).alias("body")),
        F.struct(F.lit("homoglyph").alias("variant"), t.homoglyph(F.when(chosen, body)).alias("body")),  # Python sees no other text
    ]
    forms = F.when(chosen, F.array(plain, *coded)).otherwise(F.array(plain))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(forms).alias("f")).select(*rest, "f.variant", F.col("f.body").alias(text))


def group_split(df: DataFrame, group: str, seed: int, shares: Mapping[str, float]) -> DataFrame:
    """Assign whole groups to splits of exact sizes ``int(share * n)``; the last split takes the rest."""
    groups = df.select(group).distinct().withColumn("_h", order_key(seed, group))
    ranked = number_by_hash(groups, "_h", [group], name="_rank").select(group, "_rank")
    total = groups.agg(F.count(F.lit(1)).alias("_n"))
    names = list(shares)
    split = F.lit(names[-1])
    bound = F.lit(0)
    cases: list[tuple[Column, str]] = []
    for name in names[:-1]:
        bound = bound + F.floor(F.lit(shares[name]) * F.col("_n"))
        cases.append((F.col("_rank") <= bound, name))
    for cond, name in reversed(cases):
        split = F.when(cond, name).otherwise(split)
    marked = ranked.join(F.broadcast(total)).select(group, split.alias("split"))
    return df.join(marked, group)


def sample_cap(df: DataFrame, key: str, seed: int, cap: int) -> DataFrame:
    """Seeded shuffle, then the first ``cap`` rows; digests beyond the cap's bucket are dropped before anything moves."""
    return number_by_hash(df.withColumn("_h", order_key(seed, key)), "_h", [key], name="_place", limit=cap).drop("_h", "_place")


def sample_bernoulli(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    return df.filter(fraction(seed, key) < share)


def weighted_quota(df: DataFrame, source: str, key: str, weights: Mapping[str, float], target: int, seed: int, length: Column | None = None, band: tuple[int, int] | None = None) -> DataFrame:
    """Oversampled quota per source in id order, then a seeded shuffle trimmed to the target.

    With ``band`` only rows whose ``length`` lies in it (inclusive) count towards a quota.
    """
    if band is not None:
        df = df.filter(length.between(*band))
    want = F.lit(None).cast("long")
    for name, w in weights.items():
        want = F.when(F.col(source) == name, F.lit(int(target * w * 1.5) + 50)).otherwise(want)
    top = max(int(target * w * 1.5) + 50 for w in weights.values())
    picked = first_rows(df.filter(F.col(source).isin(*weights)), source, [key], top).filter(F.col("rn") <= want)
    return sample_cap(picked.drop("rn"), key, seed, target)


def sample_triples(contexts: DataFrame, context: str, payloads: DataFrame, payload: str, positions: Sequence[str], cap: int, seed: int) -> DataFrame:
    """``cap`` distinct (context, payload, position) triples, or all there are.

    Draw ``i`` is the mixed-radix number ``i * step + seed`` modulo the number of triples. The step is a prime far
    above any list's length, so that the walk meets every triple once before it comes back; nothing is drawn twice
    and no set of seen triples is kept.
    """
    ctx, pay = numbered(contexts.select(context), context, seed, "_ci"), numbered(payloads.select(payload), payload, seed + 1, "_pi")
    n_ctx, n_pay = contexts.count(), payloads.count()
    total = n_ctx * n_pay * len(positions)
    z = F.pmod(F.col("id").cast("decimal(38,0)") * F.lit(TRIPLE_STEP) + F.lit(seed), F.lit(total).cast("decimal(38,0)")).cast("long")
    walk = contexts.sparkSession.range(min(cap, total)).select(z.alias("z"))
    spots = walk.select(t.one_of(positions, F.col("z") % len(positions)).alias("position"), F.expr(f"z div {len(positions)} div {max(1, n_pay)}").alias("_ci"),
                        F.expr(f"(z div {len(positions)}) % {max(1, n_pay)}").alias("_pi"))
    return spots.join(ctx, "_ci").join(pay, "_pi").select(context, payload, "position")


def numbered(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """0-based position under a seeded shuffle."""
    out = number_by_hash(df.withColumn("_h", order_key(seed, key)), "_h", [key], name=name)
    return out.withColumn(name, F.col(name) - 1).drop("_h")


def round_robin(df: DataFrame, bucket: str, key: str, seed: int, cap: int) -> DataFrame:
    """Draw one row per bucket in turn, buckets in name order, until ``cap`` rows."""
    ranked = number_by_hash(df.withColumn("_h", order_key(seed, key)), "_h", [key], [bucket], "turn", cap).drop("_h")
    return ranked.orderBy("turn", bucket).limit(cap)


def round_robin_dedup(df: DataFrame, bucket: str, text: str, key: str, seed: int, cap: int) -> DataFrame:
    """Round robin in which a text is drawn once: buckets draw in turn and pass over texts that another one has taken.

    The result is that of drawing one by one. Only texts of several buckets are looked at again: an entry's turn lies
    between the turn it has if every open entry before it is lost and the one it has if none is. Where another bucket
    surely comes first the entry is lost, and a text's last entry is won; turns then become narrower, until nothing is
    open. The first open entry of all is always won, so rounds end; as all texts settle side by side there are far
    fewer of them than texts. Open entries are stored in every round, and running counts are summed by cells of
    the turn axis, so no bucket is one task. A null bucket draws first; a null text is one text.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(bucket).cast("string")), F.lit("")).alias("_b")
    keyed = df.select(name, F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")).cast("binary")).alias("_t"), order_key(seed, key).alias("_h"), F.col(bucket).alias("_name"), F.col(key).alias("_key"))
    unique = keyed.groupBy("_b", "_t").agg(F.min(F.struct("_h", "_key", "_name")).alias("m")).select("_b", "_t", "m.*")
    ranked = stored(number_by_hash(unique, "_h", ["_key"], ["_b"], "_p"), "entries")
    shared = ranked.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_t")
    entries = stored(ranked.join(shared, "_t", "left_semi").select("_b", "_t", "_p", F.lit(OPEN).alias("_state")), "entries")
    while not entries.filter(F.col("_state") == OPEN).isEmpty():
        entries = stored(_settled(entries, cap), "entries")
    lost = entries.filter(F.col("_state") == LOST).select("_b", "_t")
    turns = number_by_hash(ranked.join(lost, ["_b", "_t"], "left_anti"), "_h", ["_key"], ["_b"], "turn", cap)
    return turns.orderBy("turn", "_b").limit(cap).select(F.col("_name").alias(bucket), F.col("_key").alias(key), "turn")


OPEN, WON, LOST, LATE = 0, 1, 2, 3


def _settled(entries: DataFrame, cap: int) -> DataFrame:
    """One round on entries ``_b, _t, _p, _state``: those that surely come too late are lost, a text's last one is won.

    An entry whose turn is beyond ``cap`` takes no part, and what stands behind it in its bucket neither.
    """
    state = F.col("_state")
    sums = {"lost": (state == LOST).cast("long"), "open": (state == OPEN).cast("long")}
    before = running(entries, "_p", sums, ["_b"]).select("_b", "_p", "lost_below", "open_below")
    turn = F.col("_p") - F.col("lost_below")
    bounds = entries.join(before, ["_b", "_p"]).select("_b", "_t", "_p", "_state", (turn - F.col("open_below")).alias("low"), turn.alias("high"))
    bounds = bounds.withColumn("_state", F.when((state == OPEN) & (F.col("low") > cap), LATE).otherwise(state))
    alive = state.isin(OPEN, WON)
    texts = bounds.groupBy("_t").agg(F.min(F.when(alive, F.struct("high", "_b"))).alias("best"), F.count(F.when(alive, 1)).alias("left"))
    first = bounds.filter(state == OPEN).agg(F.min(F.when(F.col("low") == F.col("high"), F.struct("high", "_b"))).alias("first"))
    seen = bounds.join(texts, "_t").join(F.broadcast(first))  # one row
    late = F.struct(F.col("low").alias("high"), "_b") > F.col("best")
    # the earliest open entry of all has its turn for certain, and nothing of its text can come before it
    beaten = F.col("best") == F.col("first")
    own = F.struct("high", "_b") == F.col("best")
    now = F.when(state != OPEN, state).when((F.col("left") == 1) | (beaten & own), WON).when(late | (beaten & ~own), LOST).otherwise(OPEN)
    return seen.select("_b", "_t", "_p", now.alias("_state"))


def length_balance(df: DataFrame, donors: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """Replace a share of the benign rows by long donors; size, labels and injections stay the same."""
    benign = df.filter("label = 0")
    need = benign.agg(F.round(F.lit(share) * F.count(F.lit(1))).cast("long").alias("_need"))
    victims = numbered(benign.select(key), key, seed, "_pos")
    victims = victims.join(F.broadcast(need)).filter("_pos < _need").select(key, "_pos")
    gifts = numbered(donors, key, seed + 1, "_pos")
    swap = victims.join(gifts.select("_pos", F.col(key).alias("donor_id"), F.col("text").alias("_new")), "_pos").drop("_pos")
    out = df.join(swap, key, "left")
    return out.withColumn("text", F.coalesce("_new", "text")).drop("_new")


def in_order(df: DataFrame, key: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """1-based position in id order, per group."""
    return number_by_value(df, key, keys=keys, name=name)


def violations(name: str, df: DataFrame) -> DataFrame:
    """Number of rows that break a rule; a clean corpus gives zero."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


MAX_FACET = 10_000


def manifest(df: DataFrame, length: str, facets: Mapping[str, str], parameters: Mapping[str, object], long: int = 1000) -> DataFrame:
    """One row on a corpus: sizes, ``value=count`` lists of some columns, and the build's parameters.

    The counts come from one pass over grouping sets. A column with more than ``MAX_FACET`` values is no facet and
    stops the job; nothing is cut.
    """
    cols = list(facets.values())
    n = F.col(length)
    g = df.groupingSets([[F.col(c)] for c in cols] + [[]], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n >= long).alias("n_long"), F.max(n).alias("len_max"), F.sum(n).alias("chars"), F.grouping_id(*cols).alias("_g"))
    whole, full = F.col("_g") == (1 << len(cols)) - 1, (1 << len(cols)) - 1
    lists = []
    for i, (name, c) in enumerate(facets.items()):
        own = F.when(F.col("_g") == full - (1 << (len(cols) - 1 - i)), F.concat(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit("="), F.col("n").cast("string")))
        too_many = F.count(own) > MAX_FACET
        lists.append(F.when(too_many, F.raise_error(F.lit(f"too many values for {name}")).cast("string")).otherwise(F.array_join(F.array_sort(F.collect_list(own)), ";")).alias(name))
    sizes = [F.max(F.when(whole, F.col(x))).alias(y) for x, y in (("n", "n_total"), ("n_long", "n_long"), ("len_max", "len_max"), ("chars", "chars"))]
    return g.agg(*sizes, *lists).withColumn("parameters", F.lit(";".join(f"{k}={v}" for k, v in parameters.items())))


def shared_phrases(spark: SparkSession, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Phrases that stand in more than one of the named sets, which must not overlap."""
    rows = spark.createDataFrame([(name, p) for name, ps in sets.items() for p in ps], "name string, phrase string")
    return rows.groupBy("phrase").agg(F.countDistinct("name").alias("n")).filter("n > 1")


def choose(words: Sequence[str], seed: int, *key: str) -> Column:
    return t.one_of(words, pick(seed, len(words), *key))


def attack_cross(carriers: DataFrame, goals: Sequence[str], wordings: Mapping[str, str], groups: int) -> DataFrame:
    """Every carrier (``suite, carrier, vector``) with every goal of its suite in every wording.

    Goal n belongs to group n modulo ``groups``; a suite's group comes from a digest of its whole name, so every
    suite, a null one included, has goals. Goals and wordings are lists of the caller and are broadcast; rows grow with
    the carriers only. A text that comes out twice in a suite is one record.
    """
    rows = [(n % groups, family, w.replace("{goal}", g)) for n, g in enumerate(goals) for family, w in wordings.items()]
    forms = carriers.sparkSession.createDataFrame(rows, "grp long, goal_family string, payload string")
    name = F.md5(F.coalesce(F.col("suite"), F.lit("")).cast("binary"))
    own = F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % groups
    head, tail = t.around_slot(F.col("carrier"))
    forms = forms.withColumn("payload", t.unescape(t.fill_tokens(F.col("payload"))))
    forms = forms.withColumn("form", F.xxhash64("grp", "goal_family", "payload"))
    # a carrier is filled once, not once a payload
    parts = carriers.select("suite", "vector", own.alias("grp"), F.explode(F.array(F.struct(head.alias("head"), tail.alias("tail")))).alias("p"))
    parts = stored(parts.select("suite", "vector", "grp", "p.*").withColumn("part", F.monotonically_increasing_id()), "carriers")
    text = t.strip(F.concat("head", "payload", "tail")).alias("text")
    x = parts.join(F.broadcast(forms), "grp").select("suite", "vector", "goal_family", "part", "form", text).filter("text <> ''")
    # digests meet, not texts: the text of a record is made again from one of the pairs it comes from
    x = x.select("suite", "vector", "goal_family", "part", "form", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    one = x.groupBy("suite", "key").agg(F.min("vector").alias("vector"), F.min("goal_family").alias("goal_family"), F.min(F.struct("part", "form")).alias("from"))
    one = one.select("vector", "goal_family", F.col("from.part").alias("part"), F.col("from.form").alias("form"))
    out = one.join(parts.drop("vector").hint("merge"), "part").join(F.broadcast(forms.select("grp", "form", "payload").distinct()), ["grp", "form"])
    return out.select("suite", "vector", "goal_family", F.lit("tool").alias("channel"), text)
