"""Fingerprints, user aggregates, phrase tables and the restart of the routed stream."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.operators import fingerprints as fp
from twinsieve.operators import phrases as ph
from twinsieve.operators.aggregates import ScoreHistogram, aggregate_by
from twinsieve.streaming.route import DECISIONS, REQUESTS, overwrite_parquet, read_sinks, run_sinks

ROWS = [(1, "a"), (2, None), (None, "b"), (3, ""), (3, "")]
SHAPE = "id long, text string"


def prints(spark, rows, name="x"):
    return fp.fingerprint(spark.createDataFrame(rows, SHAPE), name)


def verdict(now, pin):
    r = fp.compared(now, pin).first()
    return r.verdict, r.gained


def test_a_changed_an_added_and_a_doubled_row_are_told(spark):
    pin = prints(spark, ROWS)
    assert verdict(prints(spark, ROWS[::-1]), pin) == ("same", 0)
    assert verdict(prints(spark, [(1, "b"), *ROWS[1:]]), pin) == ("changed", 0)
    assert verdict(prints(spark, [*ROWS, (9, "z")]), pin) == ("changed", 1)
    assert verdict(prints(spark, [*ROWS, ROWS[0]]), pin) == ("changed", 1)
    assert verdict(prints(spark, ROWS[:-1]), pin) == ("changed", -1)
    assert verdict(prints(spark, [(1, "a"), (2, ""), *ROWS[2:]]), pin) == ("changed", 0)  # a null is not an empty text
    assert verdict(prints(spark, ROWS[:-2] + [(4, ""), (2, "")]), pin) == ("changed", 0)
    other = {r.tbl: r.verdict for r in fp.compared(prints(spark, ROWS, "y"), pin).collect()}
    assert other == {"x": "missing", "y": "unpinned"}


def test_fields_do_not_run_into_each_other(spark):
    one = fp.fingerprint(spark.createDataFrame([("a|1:b", "c")], "p string, q string"), "x")
    two = fp.fingerprint(spark.createDataFrame([("a", "1:b|c")], "p string, q string"), "x")
    assert verdict(one, two) == ("changed", 0)


def test_updates_equal_a_rescan(spark):
    rng = random.Random(5)
    old = [(rng.randrange(50), rng.choice("abc")) for _ in range(200)]
    gone, new = old[:70], [(rng.randrange(50), "new") for _ in range(30)]
    got = fp.updated(prints(spark, old), added=prints(spark, new), removed=prints(spark, gone))
    assert verdict(got, prints(spark, old[70:] + new)) == ("same", 0)
    assert verdict(fp.updated(prints(spark, old), removed=prints(spark, old)), prints(spark, [])) == ("same", 0)


def test_a_table_that_is_not_the_pinned_one_stops(spark):
    pin = prints(spark, ROWS)
    assert fp.verified(spark.createDataFrame(ROWS, SHAPE), "x", pin).count() == 5
    with pytest.raises(ValueError, match="changed, rows gained -1"):
        fp.verified(spark.createDataFrame(ROWS[1:], SHAPE), "x", pin)


def brute_auroc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return wins / len(pos) / len(neg) if pos and neg else None


@pytest.mark.parametrize("fan", [2, 64])
def test_median_and_auroc_merge_in_a_tree(spark, fan):
    rng = random.Random(fan)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(2), rng.randrange(1001) / 1000) for _ in range(900)]
    rows += [("one class", 1, 0.25), ("one class", 1, 0.5), ("no score", 0, None)]
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(11)
    got = {r.g: (r.median, r.auroc) for r in aggregate_by(df, "g", ScoreHistogram("s", "y"), ["median", "auroc"], fan).collect()}
    assert set(got) == {"hot", "b", None, "one class", "no score"}
    for g, (median, auroc) in got.items():
        pairs = [(s, y) for k, y, s in rows if k == g and s is not None]
        assert median == (statistics.median_low([s for s, _ in pairs]) if pairs else None)
        assert auroc == (pytest.approx(brute_auroc(pairs)) if brute_auroc(pairs) is not None else None)


def test_an_aggregate_over_no_rows(spark):
    df = spark.createDataFrame([], "g string, y int, s double")
    assert aggregate_by(df, "g", ScoreHistogram("s", "y"), ["median", "auroc"]).collect() == []


def test_any_mergeable_state_will_do(spark):
    class Commonest:  # the most frequent value: not a sum, and a state of any size
        def update(self, state, rows):
            return (state or Counter()) + Counter(rows["s"].tolist())

        def merge(self, one, other):
            return one + other

        def finish(self, state):
            return {"mode": min(state, key=lambda x: (-state[x], x))}

    rows = [(i % 3, float((i * i) % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, s double").repartition(7)
    got = {r.g: r.mode for r in aggregate_by(df, "g", Commonest(), ["mode"], 2).collect()}
    assert got == {g: min(c, key=lambda x: (-c[x], x)) for g in range(3) for c in [Counter(s for k, s in rows if k == g)]}


PHRASES = ["aa", "aba", "ab", "b", "é😀", "", None, "aa", "x y", "nowhere"]
TEXTS = [(1, "s", "aaaa aaa"), (2, "s", "ababa b"), (3, "t", None), (4, "t", ""), (5, None, "é😀é😀 x y"), (6, "s", "aaaa aaa"), (None, "t", "ab")]


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_phrases_are_counted_as_by_replacement(spark, limit):
    df = spark.createDataFrame(TEXTS, "id long, k string, text string")
    table = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    got = {(r.phrase, r.key): r.n for r in ph.occurrences_by(df, "text", "k", table, limit).collect()}
    want = Counter()
    for p in {p for p in PHRASES if p}:
        for _, k, x in TEXTS:
            want[p, k] += (x or "").count(p)
    assert got == {k: n for k, n in want.items() if n}


def test_ten_thousand_phrases_in_one_pass(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randrange(3, 8))) for _ in range(10_000)]
    texts = [(i, str(i % 2), "".join(rng.choices("abcd ", k=400))) for i in range(30)]
    got = ph.occurrences_by(spark.createDataFrame(texts, "id long, k string, text string"), "text", "k", spark.createDataFrame([(w,) for w in words], "phrase string"))
    want = Counter()
    for w in set(words):
        for _, k, x in texts:
            want[w, k] += x.count(w)
    assert {(r.phrase, r.key): r.n for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_no_phrases(spark):
    df = spark.createDataFrame(TEXTS, "id long, k string, text string")
    none = spark.createDataFrame([(None,), ("",)], "phrase string")
    assert ph.occurrences_by(df, "text", "k", none).collect() == []
    assert {r.payload for r in ph.longest_suffix(df, "id", "text", none).collect()} == {None}


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_the_longest_end(spark, limit):
    df = spark.createDataFrame(TEXTS, "id long, k string, text string")
    table = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    got = sorted((str(r.id), r.payload) for r in ph.longest_suffix(df, "id", "text", table, limit).collect())
    want = [(str(i), max((p for p in PHRASES if p and (x or "").endswith(p)), key=len, default=None)) for i, _, x in TEXTS]
    assert [(a, b or "") for a, b in got] == sorted((a, b or "") for a, b in want)


def test_the_first_marker_equals_the_expression(spark):
    texts = [(i, x) for i, x in enumerate([*v.MARKERS, "none", "", v.MARKERS[3] + " " + v.MARKERS[1], f"a {v.MARKERS[2]} b"])]
    df = spark.createDataFrame(texts, "id long, text string")
    want = {r.id: r.m for r in df.select("id", t.marker_of(F.col("text")).alias("m")).collect()}
    assert {r.id: r.marker for r in ph.first_present(df, "id", "text", v.MARKERS, "none/other").collect()} == want


def test_a_stop_between_the_sinks_writes_once(spark, tmp_path):
    source, state, sinks = str(tmp_path / "in"), str(tmp_path / "state"), {x: str(tmp_path / x) for x in DECISIONS}
    rows = [(i, -0.01 * (i % 300) - 0.01, -0.01 * (i * 7 % 300) - 0.01, 1_700_000_000 + i % 60) for i in range(600)]
    rows += rows[::4]  # sent again
    rows += [(None, -0.1, -2.0, 1_700_000_000)] * 2
    df = spark.createDataFrame(rows, "row_id long, logp_benign double, logp_injection double, at long")
    df.select("row_id", "logp_benign", "logp_injection", F.timestamp_seconds("at").alias("sent")).repartition(4).write.parquet(source)
    assert spark.read.parquet(source).schema.simpleString() == spark.createDataFrame([], REQUESTS).schema.simpleString()
    left = [5]

    def failing(part, path):
        left[0] -= 1
        if left[0] == 0:  # the first batch is whole, the second has its first sink only
            raise OSError("the sink is gone")
        overwrite_parquet(part, path)

    def run(write):
        run_sinks(spark, source, sinks, state, 1.0, 0.6, 0.4, files_per_batch=2, write=write)

    with pytest.raises(StreamingQueryException):
        run(failing)
    run(overwrite_parquet)
    run(overwrite_parquet)  # nothing new
    got = [r.row_id for r in read_sinks(spark, sinks).collect()]
    assert Counter(got) == Counter([*range(600), None, None])
    assert {r.decision for r in read_sinks(spark, sinks).collect()} == set(DECISIONS)


def test_a_decision_without_a_sink_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="escalate"):
        run_sinks(spark, str(tmp_path), {"pass": "a", "block": "b"}, "c", 1.0, 0.6, 0.4)
