"""The pipeline, stage by stage, against plain Python; and the library without this subpackage."""

import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_retrieval_and_chat import shares
from tests.llm.test_simhash import groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    out, docs = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_stages(spark, kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(set(kept[n][0]) == set(COLUMNS) for n in names[:-1])
    ids = lambda n: sorted(r["doc_id"] for r in kept[n])
    # quality: what fails the base rules goes, and nothing comes in
    failed = {r["doc_id"] for r in kept["documents"] if brute.quality(r["text"])["base_failed"]}
    assert set(ids("quality")) <= set(ids("documents")) - failed and len(kept["quality"]) > 0.7 * len(kept["documents"])
    # one document of each group
    fp = {r["doc_id"]: brute.simhash(r["text"]) for r in kept["quality"]}
    comp = groups([(a, b) for a in fp.values() for b in fp.values() if (a ^ b).bit_count() <= 4], set(fp.values()))
    least = {}
    for i, f in sorted(fp.items()):
        least.setdefault(comp[f], i)
    assert ids("near-duplicates") == sorted(least.values())
    # no benchmark item is left, and nothing else goes
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids("decontamination") == sorted(r["doc_id"] for r in kept["near-duplicates"] if not any(shares(r["text"], x) >= 0.8 for x in items))
    # the mix takes each source near its target, no document more than three times
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept["decontamination"]:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in kept["mixing"]:
        taken[r["source"]] += len(brute.words(r["text"]))
    want = brute.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in kept["mixing"]).values()) <= 3
    # shards in id order, by bytes
    assert Counter(r["doc_id"] for r in kept["sharding"]) == Counter(r["doc_id"] for r in kept["mixing"])
    rows = sorted(((r["doc_id"], zlib.crc32(r["text"].encode()), len(r["text"].encode()) + 1) for r in kept["mixing"]))
    total, before, wanted = sum(r[2] for r in rows), 0, []
    for i, _, s in rows:
        wanted.append((i, min(15, (2 * before + s) * 16 // (2 * total))))
        before += s
    assert sorted((r["doc_id"], r["shard"]) for r in kept["sharding"]) == sorted(wanted)


def test_run_equals_the_stages(spark, kept):
    got = sorted([tuple(str(r[c]) for c in [*COLUMNS, "shard", "slot"]) for r in corpus_pipeline.run(spark, SF).collect()])
    assert got == sorted(tuple(str(r[c]) for c in [*COLUMNS, "shard", "slot"]) for r in kept["sharding"])


def test_awkward_documents(spark, tmp_path):
    good = " ".join(f"the word{i} of line{i * 7 % 13}" for i in range(40))
    rows = [(None, good, "en", None, 1), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, good, "en", "a", 1), (3, good, "en", "a", 1), (4, good + " more", "en", "b", 1),
            (5, " ".join(f"the x{i}" for i in range(40_000)), "fr", None, 1)]
    docs = spark.createDataFrame([(*r, 7, "s", "r", 0, "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, row string, kept int, _carry string")
    for start in (docs, docs.limit(0)):
        d = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{start is docs}-{n}"
            stage(spark, d, SF).write.parquet(path)
            d = spark.read.parquet(path)
            assert set(COLUMNS) <= set(d.columns) and "_carry" in d.columns
        got = d.collect()
        assert not got if start is not docs else len({r.doc_id for r in got}) == len({r.doc_id for r in got} & {None, 3, 4, 5})


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the other queries are still there."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "twinsieve", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "twinsieve")
    for name in os.listdir(f"{root}/twinsieve"):
        if name != "llm":
            os.symlink(f"{root}/twinsieve/{name}", tmp_path / "twinsieve" / name)
    with open(f"{root}/__spark_entry__.py") as f:
        code = f.read()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(code)
    run = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 150 and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_one_row_of_each_group(spark):
    """Null ids and shared ids do not decide which row stays."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(3, "A", "x"), *[(7, t, "y") for t in "ABCDEFGH"], (None, "A", "z"), (None, "I", "p"), (None, "I", "q"), (None, "J", "r"), (9, "J", "s"), (9, "K", "t"), (9, "K", "t")]
    docs = spark.createDataFrame([(i, text(k), k, s) for i, k, s in rows], "doc_id long, text string, lang string, source string").repartition(4)
    got = [(r.doc_id, r.lang) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(3, "A"), *[(7, t) for t in "BCDEFGH"], (None, "I"), (9, "J"), (9, "K")], key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), SF).count() == 0
