import base64
import codecs
import hashlib
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.functions.sketches import gram_hashes, jaccard, permutations, signature
from twinsieve.operators import corpus as c
from twinsieve.operators import neardup as nd
from twinsieve.operators import vectors as vec

TEXTS = ["Hello,  World!", " a\tb\n\nc ", "ÀÉ ñ—x ½ ² {x}", "", "abc", "emoji 😀 here", "zero​width"]


def col(spark, fn, texts=TEXTS):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_normalisers_equal_python(spark):
    def exact(x):
        return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", x.lower())).strip()

    def near(x):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x.replace("​", "").lower())).strip()

    assert col(spark, t.norm_exact) == [exact(x) for x in TEXTS]
    assert col(spark, t.norm_neardup) == [near(x) for x in TEXTS]


def test_encoders_equal_python(spark):
    long = TEXTS + ["long text " * 40]
    assert col(spark, t.base64_text, long) == [base64.b64encode(x.encode()).decode() for x in long]
    assert col(spark, t.rot13, long) == [codecs.encode(x, "rot_13") for x in long]
    swapped = col(spark, t.homoglyph, ["aeocpx" * 200])[0]
    share = sum(ch in v.CYRILLIC for ch in swapped) / len(swapped)
    assert 0.25 < share < 0.35 and len(swapped) == 1200


def test_shingles_equal_python(spark):
    def want(x, k=5):
        return ([x] if x else []) if len(x) < k else list({x[i : i + k] for i in range(len(x) - k + 1)})

    assert [sorted(s) for s in col(spark, lambda x: t.shingle_set(x))] == [sorted(want(x)) for x in TEXTS]
    assert col(spark, lambda x: t.tail_shingles(x), ["abc"]) == [[]]


def test_suffix_swap_keeps_trailing_space(spark):
    text = "carrier list the colours and count the words \n"
    assert col(spark, lambda x: t.find_suffix(x, v.GOALS), [text]) == ["list the colours and count the words"]
    got = col(spark, lambda x: t.swap_suffix(x, t.find_suffix(x, v.GOALS), F.lit("NEW")), [text])
    assert got == ["carrier NEW \n"]


def test_slots_and_prompt_braces(spark):
    assert col(spark, lambda x: t.fill_slots(x, F.lit("PAY")), ["a {injection_1} b {title} c {injection_2}\\n"]) == ["a PAY b Weekly meeting c <injection_2>"]
    p = col(spark, lambda x: t.prompt(v.CHAT_TEMPLATES["tagged"], x), ["braces {text} {0} stay"])[0]
    assert "Text:\nbraces {text} {0} stay\n\nLabel:" in p and p.endswith("<|im_start|>assistant\n")


def test_validation_stops_on_unknown_labels(spark):
    df = spark.createDataFrame([("some text", "odd", "direct")], "t string, l string, ch string")
    with pytest.raises(PySparkException):
        c.validated(df, "t", "l", "ch", ["safe", "unsafe"], ["direct"]).collect()


def test_groups_never_cross_splits_and_sizes_are_exact(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 250).alias("g"))
    out = c.group_split(df, "g", 42, {"train": 0.8, "val": 0.1, "cal": 0.1})
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.split: r.n for r in out.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"train": 200, "val": 25, "cal": 25}
    again = c.group_split(df.repartition(9), "g", 42, {"train": 0.8, "val": 0.1, "cal": 0.1})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_dedup_is_idempotent_and_survives_a_hot_group(spark):
    df = spark.range(0, 900).select("id", F.when(F.col("id") % 3 == 0, "Same, text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    once = c.dedup_exact(df, "text", "id")
    assert once.count() == 601 and once.filter("id = 0").count() == 1
    assert c.dedup_exact(once, "text", "id").count() == 601


def test_round_robin_alternates(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "id bigint, b string")
    assert [r.b for r in c.round_robin(df, "b", "id", 1, 6).orderBy("turn", "b").collect()] == ["a", "b", "a", "b", "a", "a"]


@pytest.fixture(scope="module")
def near_fixture(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    texts = list(base)
    for x in base[:20]:  # near copies
        w = x.split()
        w[3] = "changed"
        texts.append(" ".join(w))
    texts += [base[0]] * 60  # one text holds a large share of the rows
    texts += ["ab", "", "ab"]
    return [(i, x) for i, x in enumerate(texts)]


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_equal_brute_force(spark, near_fixture, exact, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)  # many small blocks
    cands, refs = [r for r in near_fixture if r[0] % 2], [r for r in near_fixture if r[0] % 2 == 0]
    g = {i: gram_hashes(re.sub(r"\s+", " ", x).strip()) for i, x in near_fixture}
    want = {}
    for i, _ in cands:
        scored = [(jaccard(g[i], g[j]), -j) for j, _ in refs]
        s, j = max(scored)
        if s >= 0.5:
            want[i] = (-j, s)
    schema = "id bigint, text string"
    got = nd.near_duplicates(spark.createDataFrame(cands, schema), spark.createDataFrame(refs, schema), exact=exact).collect()
    assert {r.id: (r.match_id, r.jac) for r in got} == want


def test_knn_equals_brute_force_with_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vec, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[:100] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, r = [(i, x[i].tolist()) for i in range(1, 300, 2)], [(i, x[i].tolist()) for i in range(0, 300, 2)]
    got = vec.knn(spark.createDataFrame(q, "id bigint, vec array<float>"), spark.createDataFrame(r, "id bigint, vec array<float>"), 5).collect()
    mine = {}
    for row in got:
        mine.setdefault(row.id, []).append((row.place, row.match_id))
    for i, _ in q:
        sim = [(-round(float(x[i].astype(np.float64) @ x[j].astype(np.float64)), 9), j) for j, _ in r]
        assert [m for _, m in sorted(mine[i])] == [j for _, j in sorted(sim)[:5]]


def test_dedup_keeps_rows_without_an_id_and_tells_rows_of_one_id_apart(spark):
    rows = [(1, "A  b"), (5, "x"), (5, "a b"), (None, "only here"), (None, "x"), (None, "only HERE"), (7, None), (None, None)]
    df = spark.createDataFrame([(i, x, n) for n, (i, x) in enumerate(rows)], "id bigint, text string, n int").repartition(3)
    got = sorted(((r.id, r.text) for r in c.dedup_exact(df, "text", "id").collect()), key=str)
    assert got == sorted([(1, "A  b"), (5, "x"), (None, "only HERE"), (7, None)], key=str)
    per_n = c.dedup_exact(df.withColumn("n", F.col("n") % 2), "text", "id", "n")
    assert per_n.count() == 6 and per_n.columns == ["id", "text", "n"]


def test_attack_cross_gives_every_suite_its_goals(spark):
    carriers = spark.createDataFrame([("a", "x {injection_1} y", "injection_1"), (None, "{injection_2}.", "injection_2"), ("zürich", "{injection_3}", "injection_3"), ("a", "x {injection_1} y", "injection_1")],
                                     "suite string, carrier string, vector string")
    goals, wordings = ["g0", "g1", "g2", "g3"], {"plain": "{goal}", "twice": "{goal} {goal}"}
    got = c.attack_cross(carriers, goals, wordings, 3).collect()
    for suite, text in (("a", "x {} y"), (None, "{}."), ("zürich", "{}")):
        own = int(hashlib.md5((suite or "").encode()).hexdigest()[:8], 16) % 3
        want = {text.format(w.format(goal=g)) for n, g in enumerate(goals) if n % 3 == own for w in wordings.values()}
        assert {r.text for r in got if r.suite == suite} == want


def hot_band_texts(n):
    """Texts of which a third shares one MinHash band and hardly anything else; every ninth has a near copy on the other side."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    a, b = permutations(3131)
    tries = ["".join(x) for x in rng.choice(letters, (60_000, 5))]
    hashes = np.array([gram_hashes(x)[0] for x in tries]).view(np.uint64) >> np.uint64(32)
    least = [tries[int((a[i] * hashes.astype(np.uint32) + b[i]).argmin())] for i in range(4)]  # the four minima of band 0
    word = lambda: "".join(rng.choice(letters, 7))
    texts = []
    for i in range(n):
        words = [word() for _ in range(25)]
        if i % 3 == 0:
            words[3:3] = least
        texts.append(" ".join(words))
    return texts


def test_work_on_a_hot_band_grows_less_than_its_square(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    pairs, found = [], []
    for n in (240, 960):
        texts = hot_band_texts(n)
        refs = [(2 * i, t) for i, t in enumerate(texts)]
        others = hot_band_texts(2 * n)[n:]  # a hot third as well
        cands = [(2 * i + 1, t.replace(" ", " x", 1) if i % 9 == 0 else others[i]) for i, t in enumerate(texts)]
        frames = [nd.normalised(spark.createDataFrame(x, "id bigint, text string")) for x in (cands, refs)]
        sign = signature()
        both = [f.select(F.lit(s).alias("side"), "id", sign("norm").alias("s")).select("side", "id", "s.*", F.size("s.grams").alias("n")) for s, f in enumerate(frames)]
        hottest = both[1].select(F.posexplode("bands").alias("band", "key")).groupBy("band", "key").count().agg(F.max("count")).first()[0]
        assert hottest >= n / 4
        cut = nd._cut(nd.lsh_places(both[0].unionByName(both[1])))
        pairs.append(cut.agg(F.sum(F.col("t0") * F.col("t1"))).first()[0])
        got = {r.id: r.match_id for r in nd.lsh_best(*frames).collect()}
        found.append(sum(got.get(2 * i + 1) == 2 * i for i in range(0, n, 9)) / len(range(0, n, 9)))
    assert found == [1.0, 1.0] and pairs[1] < 6 * pairs[0]  # four times the texts; the square would be sixteen


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_without_ids_and_under_one_id(spark, exact):
    say = lambda n: " ".join(f"{n}w{j}" for j in range(40))
    cands = [(None, say(1)), (None, say(2)), (7, say(3) + " edited"), (7, say(4)), (8, say(9)), (9, None)]
    refs = [(None, say(1)), (2, say(2)), (3, say(2)), (5, say(3)), (5, say(4)), (None, say(4)), (6, None)]
    schema = "id bigint, text string"
    got = nd.near_duplicates(spark.createDataFrame(cands, schema), spark.createDataFrame(refs, schema), exact=exact).collect()
    assert sorted(((r.id, r.match_id, round(r.jac, 1)) for r in got), key=str) == sorted([(None, None, 1.0), (None, 2, 1.0), (7, 5, 1.0), (7, 5, 1.0)], key=str)


def drawn_one_by_one(rows, seed, cap):
    """(bucket, text, id) rows: buckets in turn, null first, each takes its next text that nobody has."""
    lists = {}
    for bucket, text, i in sorted(rows, key=lambda r: hashlib.md5(f"{seed}:{r[2]}".encode()).hexdigest()):
        if text not in [t for t, _ in lists.setdefault(bucket, [])]:
            lists[bucket].append((text, i))
    out, taken, turn = [], set(), 0
    order = sorted(lists, key=lambda b: (b is not None, b or ""))
    while len(out) < cap and any(lists.values()):
        turn += 1
        for b in order:
            lists[b] = [x for x in lists[b] if x[0] not in taken]
            if lists[b] and len(out) < cap:
                text, i = lists[b].pop(0)
                taken.add(text)
                out.append((b, i, turn))
    return out


@pytest.mark.parametrize(("n", "buckets", "texts", "cap"), [(300, 5, 60, 40), (200, 3, 400, 1000), (120, 12, 15, 1000)])
def test_round_robin_passes_over_taken_texts(spark, n, buckets, texts, cap):
    rng = np.random.default_rng(n + texts)
    names = [None, "a", "b", "", *(f"s{i}" for i in range(20))][:buckets]
    rows = [(names[int(rng.integers(buckets))], None if rng.random() < 0.03 else f"t{rng.integers(texts)}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "b string, x string, id bigint").repartition(3)
    got = [(r.b, r.id, r.turn) for r in c.round_robin_dedup(df, "b", "x", "id", 7, cap).collect()]
    want = drawn_one_by_one(rows, 7, cap)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_gram_sets_do_not_move(spark, near_fixture, monkeypatch):
    """What is stored of a text is its sketch and a digest, not its gram set."""
    schemas = []
    monkeypatch.setattr(nd, "stored", lambda df, tag, keep=nd.stored: schemas.append(df.schema.names) or keep(df, tag))
    frames = [nd.normalised(spark.createDataFrame([r for r in near_fixture if r[0] % 2 == s], "id bigint, text string")) for s in (1, 0)]
    nd.lsh_best(*frames).count()
    nd.exact_best(*frames).count()
    assert schemas and not any({"grams", "g"} & set(names) for names in schemas)


def test_best_candidate_without_threshold_equals_brute_force(spark, near_fixture, monkeypatch):
    """Without a margin only the highest bound is compared first; a second round settles what that leaves open."""
    monkeypatch.setattr(nd, "_margin", lambda n: 0.0 * n)
    rows = {i: x for i, x in near_fixture if x and i < 80}
    frames = [spark.createDataFrame([(i, x) for i, x in rows.items() if i % 2 == s], "id bigint, norm string") for s in (1, 0)]
    got = {r.id: r.jac for r in nd.lsh_best(*frames, threshold=0.0).collect()}
    g = {i: gram_hashes(x) for i, x in rows.items()}
    want = {i: max(jaccard(g[i], g[j]) for j in rows if j % 2 == 0) for i in rows if i % 2}
    assert all(got[i] == w for i, w in want.items() if w >= 0.5)


def test_knn_copies_a_query_once_a_block_not_once_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frames = [spark.createDataFrame([(i, x[i].tolist()) for i in range(s, 400, 2)], "id bigint, vec array<float>") for s in (1, 0)]
    counts = {}

    def counted(df, tag, keep=vec.stored):
        out = keep(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(vec, "stored", counted)
    assert vec.knn(*frames, 5).count() == 1000 and counts["routed"] == 200  # all references are one block


def test_homoglyphs_see_chosen_texts_only(spark):
    df = spark.createDataFrame([(1, 1, "apex"), (2, 0, "apex"), (3, 1, None)], "id long, label long, text string")
    plan = c.with_variants(df, "text", F.col("label") == 1)
    assert sorted((r.id, r.variant) for r in plan.collect()) == sorted([(i, v) for i in (1, 3) for v in ("original", "b64", "rot13", "homoglyph")] + [(2, "original")])
    assert "CASE WHEN (label" in plan._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].split("\n")[0]


def test_texts_of_attack_cross_do_not_move(spark):
    carriers = spark.createDataFrame([("s", "a {injection_x} b", "injection_x")], "suite string, carrier string, vector string")
    plan = c.attack_cross(carriers, ["g"], {"plain": "{goal}"}, 1)
    assert [r.text for r in plan.collect()] == ["a g b"]
    assert not re.search(r"Aggregate \[[^\]]*\btext#", plan._jdf.queryExecution().optimizedPlan().toString())


def test_slots_are_filled_from_one_copy_of_the_text(spark):
    x = t.fill_slots(F.concat(F.col("text"), F.lit(" {injection_1}")), F.lit("P"))
    df = spark.createDataFrame([("a{b}",)], "text string").select(x.alias("y"))
    assert df.collect()[0].y == "a<b> P" and df._jdf.queryExecution().optimizedPlan().toString().count("concat(text") == 1
