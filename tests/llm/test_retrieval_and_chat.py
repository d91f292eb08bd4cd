"""Decontamination against plain shingle sets, chat formatting by round trip."""

import random

import pytest

from twinsieve.llm import decontam
from twinsieve.llm.chat import PAIRS, neighbours, preference_pairs
from twinsieve.llm.decontam import clean_documents, contaminated, tokens

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, score int, item_id string", "item_id long, text string, doc_id int"


def shares(text, item):
    """Share of an item's shingles anywhere in a text."""
    a, b = tokens(item), tokens(text)
    k = min(5, len(a))
    if not k:
        return 0.0
    there = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)}
    own = [tuple(a[i:i + k]) for i in range(len(a) - k + 1)]
    return sum(g in there for g in own) / len(own)


def test_leaks_are_found_and_clean_text_is_left(spark):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rnd.randint(8, 120)).capitalize()}? {say(rnd.randint(1, 9)).capitalize()}.") for i in range(60)] + [(60, "Tiny item."), (61, None), (62, " ... "), (None, say(20)), (5, say(900))]
    items.append(items[0])
    texts = [None, "", "Tiny", "a TINY  item, here"] + [say(rnd.randint(0, 700)) for _ in range(40)]
    for i, t in items[:25]:
        words = (t or "").split()
        texts += [f"{say(rnd.randint(0, 300))}\n{t}\n{say(rnd.randint(0, 300))}", " ".join(words[: len(words) // 2]), say(5) + " " + t.upper().replace(" ", " - ")]
        if len(words) > 60:  # one edit leaves well over 0.8
            texts.append(say(40) + " " + " ".join([*words[:9], "edited", *words[10:]]))
    docs = [(n, t) for n, t in enumerate(texts)] + [(None, items[3][1]), (7, items[4][1]), (7, items[4][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = [(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()]
    want = [(d, i) for d, t in docs for i, x in dict.fromkeys(items) if shares(t or "", x or "") >= 0.8]
    assert sorted(got, key=str) == sorted(want, key=str)
    dirty = {t for _, t in docs if any(shares(t or "", x or "") >= 0.8 for _, x in items)}
    left = [(r.doc_id, r.text) for r in clean_documents(df, bench).collect()]
    assert sorted(left, key=str) == sorted([(d, t) for d, t in docs if t not in dirty], key=str)


def test_several_indexes_and_empty_tables(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, contaminated(docs, bench).collect()))
    assert one and all(r[5] >= 0.8 for r in one)
    items = {r.item_id: r.text for r in bench.collect()}
    assert {(r[0], r[1]) for r in one} == {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if shares(d.text, t) >= 0.8}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 2000)
    assert sorted(map(tuple, contaminated(docs, bench).collect())) == one
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    assert clean_documents(docs, bench.limit(0)).count() == docs.count()


def expected(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    text = lambda turns: "".join(f"<|{r if r is not None else 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in turns)
    return n, text(a[:n]), text(a[n:]), text(b[n:])


@pytest.mark.parametrize("source", ["made", "given"])
def test_preference_pairs(spark, source):
    if source == "given":
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    else:
        rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "é\U0001f600"), (0, 2, "user", None), (0, 3, "assistant", "yes<|end|>"),
                (1, 0, "user", "hi"), (1, 1, "assistant", "é\U0001f600"), (1, 2, "user", None), (1, 3, "assistant", "no"), (1, 4, None, "x"),
                (4, 0, "user", "alone"), (7, 0, "user", "only rejected"), (7, 1, "assistant", "z" * 200_000),
                (8, 0, "user", "same"), (9, 0, "user", "same"), (10, 1, "b", "t"), (10, 1, "a", "t"), (10, 1, "a", "t"), (10, None, "c", ""), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pair_id int, chosen string")
    got = {r.pair_id: r for r in preference_pairs(neighbours(df)).collect()}
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(c, []).append((r, x))
    assert set(got) == {c // 2 for c in convs}
    for p, r in got.items():
        a, b = convs.get(2 * p, []), convs.get(2 * p + 1, [])
        n, prompt, chosen, rejected = expected(a, b)
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, r.identical) == (n, prompt, chosen, rejected, a == b)
        for turns, text, mask in ((a[n:], chosen, r.chosen_mask), (b[n:], rejected, r.rejected_mask)):
            assert [text[m.start:m.end] for m in mask] == [(t or "") + "<|end|>\n" for role, t in turns if role == "assistant"]
    assert preference_pairs(neighbours(df.limit(0))).count() == 0 and PAIRS.startswith("pair_id")


def test_pairs_of_ids_beyond_exact_doubles(spark):
    rows = [(2**60 + i, 0, "user", f"turn of {i}") for i in range(4)] + [(-3, 0, "user", "negative"), (-4, 0, "user", "too")]
    got = preference_pairs(neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.pair_id: (r.chosen.count("turn of"), r.rejected.count("turn of")) for r in got} == {2**59: (1, 1), 2**59 + 1: (1, 1), -2: (0, 0)}


@pytest.mark.parametrize("gap", [10, 30, 500])
def test_insertion_at_every_offset(gap):
    """A copy of 32 words with words put in, wherever it stands in the text."""
    item = " ".join(f"q{i}" for i in range(31)) + ". a31"
    index = decontam.Index([(1, item)], {t: 1 for t in tokens(item)}, 1, 32.0)
    words = item.split()
    copy = [*words[:16], *(f"put{i}" for i in range(gap)), *words[16:]]
    for offset in range(70):
        text = " ".join([*(f"x{i}" for i in range(offset)), *copy, "end"])
        assert shares(text, item) == 24 / 28 and index.matches(text)[0][3] == 24 / 28


@pytest.mark.parametrize("answer", [1, 3, 5])
def test_edit_in_the_last_sentence(spark, answer):
    """A short last sentence that is edited or cut off hides no copy."""
    item = " ".join(f"q{i}" for i in range(60)) + ". " + " ".join(f"a{i}" for i in range(answer))
    words = item.split()
    texts = [" ".join([*words[:k], "edited", *words[k + 1:]]) for k in range(len(words) - 6, len(words))] + [" ".join(words[:-answer])]
    assert all(0.8 <= shares(t, item) < 1 for t in texts)
    docs = spark.createDataFrame([(n, t, 1, "x") for n, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, item, 0)], ITEMS)
    got = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert {n: r.overlap for n, r in got.items()} == {n: shares(t, item) for n, t in enumerate(texts)}
    assert got[len(texts) - 1].answer_overlap == 0
    assert clean_documents(docs, bench).count() == 0


def test_nearly_all_weight_in_words_that_may_miss():
    """Items of long common text and a few rare words are found without those words."""
    common = [f"c{i}" for i in range(80)]
    items = [(n, " ".join([f"rare{n}", *common, *(f"rare{n}x{j}" for j in range(12))])) for n in range(400)]
    df = {t: 400 if t in common else 1 for _, x in items for t in tokens(x)}
    index = decontam.Index(items, df, 400, 93.0)
    text = " ".join(common)
    assert all(shares(text, x) >= 0.8 for _, x in items)
    assert {index.ids[i]: m[3] for i, m in index.matches(text).items()} == {n: shares(text, x) for n, x in items}
