"""Bootstrap draws made by batch: the same as the digests of single rows, and rows are not multiplied before they are summed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.functions import hashing as h
from twinsieve.operators import bootstrap as b

KEYS = [None, "", "0", "-7", "12345678901234567890", "k" * 48, "k" * 49, "k" * 50, "k" * 51, "k" * 200, "ключ", "ключ" * 9, "a\x00", "a"]


def test_draws_of_a_batch_are_those_of_single_digests(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "i int, key string")
    df = df.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(104)))).withColumn("_d", h.draws_of(3, F.col("_g"), F.col("key")))
    want = {(r.i, r["_g"]): r for r in df.select("i", "_g", "_d", *[h.poisson1("_d", F.lit(j)).alias(f"w{j}") for j in range(4)]).collect()}
    seen = 0
    for some, draws in h.draws_in(3, 105, [None if k is None else k.encode() for k in KEYS]):
        for k, g in enumerate(range(some.start, some.stop)):
            for i in range(len(KEYS)):
                row = want[i, g]
                assert "".join(f"{int(x[k, i]):08x}" for x in draws) == row["_d"]
                assert [int(h.poisson1_in(x)[k, i]) for x in draws] == [row[f"w{j}"] for j in range(4)]
                seen += 1
    assert seen == len(want)


def test_rows_are_not_multiplied_by_replicates(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), F.lit(1.0).alias("v"))
    sums = b.replicate_sums(df, "row_id", 100, 0, {"s": F.col("v")}, ["g"])
    before = sums._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(before) == 2 and "Generate" not in before[1], "rows are exploded before their sums"


def test_sums_of_copies_nulls_and_large_groups(spark):
    rows = [(None, "x", 2, 0.5), (None, "x", 3, None), (1, None, 1, 1.0), (1, None, None, 2.0), (2, "y", None, None)] + [(9, "x", 1, 0.25)] * 40 + [(i, "x", 1, float(i)) for i in range(10, 400)]
    df = spark.createDataFrame(rows, "id bigint, g string, v long, x double")
    got = {(r.g, r.rep): (r.v, r.x) for r in b.replicate_sums(df, "id", 6, 1, {"v": F.col("v"), "x": F.col("x")}, ["g"]).collect()}
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("_d", h.draws_of(1, F.floor(F.col("rep") / 4).cast("int"), F.col("id")))
    w = h.poisson1("_d", F.col("rep") % 4)
    want = {(r.g, r.rep): (r.v, r.x) for r in each.groupBy("g", "rep").agg(F.sum(F.col("v") * w).alias("v"), F.sum(F.col("x") * w).alias("x")).collect()}
    assert got.keys() == want.keys() and len(got) == 18
    for k, (v, x) in want.items():
        assert got[k][0] == v and got[k][1] == pytest.approx(x)


@pytest.mark.parametrize("tied", [False, True])
def test_rates_of_many_and_of_tied_scores(spark, tied):
    """Thresholds are found through two cuts: with every score its own and with a third of the rows on one."""
    rng = np.random.default_rng(4)
    n = 6000
    y, p1, s2 = rng.integers(0, 2, n), rng.random(n), rng.random(n)
    s2 = np.where(y == 1, s2 ** 0.25, s2)
    if tied:
        s2[: n // 3] = 0.97
    df = spark.createDataFrame([(i, int(y[i]), float(p1[i]), float(s2[i])) for i in range(n)], "row_id bigint, label bigint, p1 double, s2 double")
    draws = np.concatenate([h.poisson1_in(np.stack(d, 1)).reshape(-1, n) for _, d in h.draws_in(0, 2, [str(i).encode() for i in range(n)])])
    got = {r.rep: r for r in b.replicate_rates(df, "row_id", 0.7, n=8).collect()}
    assert sorted(got) == list(range(8))
    for rep, c in enumerate(draws):
        yy, pp, ss = np.repeat(y, c), np.repeat(p1, c), np.repeat(s2, c)
        benign, esc = np.sort(ss[yy == 0]), np.sort(ss[(yy == 0) & (pp < 0.7)])
        alone = benign[int(np.ceil((len(benign) - 1) * 0.99))]
        both = esc[int(np.ceil((len(esc) - 1) * (1 - min(1.0, 0.01 * len(benign) / len(esc)))))]
        assert got[rep].stage2_dr == pytest.approx((ss[yy == 1] > alone).mean())
        assert got[rep].cascade_tpr == pytest.approx(((ss > both) & (pp < 0.7))[yy == 1].mean())


def test_reports_make_no_digest_a_row_and_replicate_in_expressions(spark, monkeypatch):
    """The bootstrap inside ``indist_report`` is the operator's."""
    from twinsieve.plans import cost

    def never(*_):
        raise AssertionError("a digest for every row and replicate in Spark's expressions")

    monkeypatch.setattr(b, "draws_of", never)
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("label"), (F.col("id") * 37 % 101 / 101).alias("p1"), (F.col("id") * 53 % 97 / 97).alias("s2"))
    assert cost.b.gap(df, "row_id", 0.7, n=12).first().n_boot == 12


def test_report_sketches_its_second_score_once_and_equals_its_sql(spark, monkeypatch, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from tools.check import rows_of
    from twinsieve.operators import ranks

    i = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("view", "error", "click")])
    spark.range(1500).select(i.alias("event_id"), (i * 7 % 59).alias("user_id"), F.element_at(kinds, (i * 11 % 3 + 1).cast("int")).alias("event_type"), (i * 13 % 101 / 4).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    seen, sketch = [], ranks._cuts_and_groups
    monkeypatch.setattr(ranks, "_cuts_and_groups", lambda df, value, keys: seen.append(value) or sketch(df, value, keys))
    df = entry.queries()["indist_report"](spark, str(tmp_path))
    assert "s2" not in seen, "a branch of the report cuts the score again"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    rel = con.execute(entry.oracle_sql()["indist_report"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())
