"""Token alignment against plain loops over bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import tokenlinks
from twinsieve.llm.tokenlinks import BYTE_BPE, PIECE_BPE, Csr, align_tokens, overlap_links, row_products, slices, transposed

SCHEMA = "doc_id long, text string, n_a int, chunk string, pair string, docs int"
TEXTS = [None, "", " ", "  two  spaces ", "plain words here", "naïve café \U0001f600 日本語のテキスト", "▁ odd", "a▁b", "<s> </s> <unk> <|endoftext|>", "tab\tnew\nline\r\n",
         "x" * 3000, "word " * 60_000 + "end", " no-break em", "é combining", "1234567890 3.14159", "0x<0x41>", "\x00\x01", "plain words here"]


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    back = {c: b for b, c in shown.items()}

    def bytes_a(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    def both(text):
        whole = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "", num_threads=1)
        if not text or b"".join(map(bytes_a, ia)) != whole or b"".join(map(bytes_b, ib)) != whole:
            return [], []
        return spans(ia, bytes_a), spans(ib, bytes_b)

    return both


def links_of(sa, sb):
    """By every pair for short texts, else by the tokens at every byte."""
    if len(sa) * len(sb) < 10_000:
        return {(i, j) for i, (_, p, q) in enumerate(sa) for j, (_, r, s) in enumerate(sb) if p < s and r < q}
    ta, tb = ([i for i, (_, p, q) in enumerate(x) for _ in range(p, q)] for x in (sa, sb))
    return set(zip(ta, tb))


def groups_of(sa, sb):
    cuts = sorted({q for *_, q in sa} & {q for *_, q in sb})
    out, i, j = [], 0, 0
    for c in cuts:
        left, right = [], []
        while i < len(sa) and sa[i][2] <= c:
            left.append(sa[i][0])
            i += 1
        while j < len(sb) and sb[j][2] <= c:
            right.append(sb[j][0])
            j += 1
        out.append((left, right))
    return out


def brute(texts, both):
    spans = [both(t) for t in texts]
    links = [[(sa[i][0], sb[j][0]) for i, j in links_of(sa, sb)] for sa, sb in spans]
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (sa, sb), ls in zip(spans, links):
        gs = groups_of(sa, sb)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((len(sa), len(sb), len(gs), len(ls), sum(len(x) * len(y) for x, y in gs), hashlib.sha256(said.encode()).hexdigest() if sa else "",
                    sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls)))
    return out, count, best


def test_row_products():
    rnd = np.random.default_rng(3)
    x, y = (rnd.random((30, 40)) < 0.1), (rnd.random((40, 20)) < 0.2)
    a, b = (Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], m.shape[1]) for m in (x, y))
    c, values = row_products(a, b)
    dense = np.zeros((30, 20), int)
    dense[np.repeat(np.arange(30), np.diff(c.indptr)), c.indices] = values
    assert (dense == x.astype(int) @ y.astype(int)).all()
    back = transposed(a)
    dense = np.zeros((40, 30), bool)
    dense[np.repeat(np.arange(40), np.diff(back.indptr)), back.indices] = True
    assert (dense == x.T).all()


@pytest.mark.parametrize("chunk", [40, 1000, 1 << 21])
def test_awkward_texts(spark, vocabularies, chunk):
    df = spark.createDataFrame([(i if i % 7 else None, t, 1, "x", "y", 3) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    want, count, best = brute(TEXTS, vocabularies)
    per_text, pairs = align_tokens(df, chunk_chars=chunk)
    got = sorted((tuple(r) for r in per_text.collect()), key=str)
    assert got == sorted(((i if i % 7 else None, *w) for i, w in enumerate(want)), key=str)
    assert {(r.a_id, r.b_id): (r.total, r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}
    assert sum(w[0] == 0 for w in want) >= 4


def test_documents(spark, vocabularies):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, *_ = brute([t for _, t in rows], vocabularies)
    got = {r[0]: tuple(r)[1:] for r in align_tokens(docs)[0].collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_the_links(spark, vocabularies):
    texts = [t for t in TEXTS if not t or len(t) < 100]
    df = spark.createDataFrame([(i, t, 1, "x", "y", 3) for i, t in enumerate(texts)], SCHEMA)
    want = []
    for n, t in enumerate(texts):
        sa, sb = vocabularies(t)
        want += [(n, i, sa[i][0], j, sb[j][0], min(sa[i][2], sb[j][2]) - max(sa[i][1], sb[j][1])) for i, j in links_of(sa, sb)]
    assert sorted(map(tuple, overlap_links(df).collect())) == sorted(want)
    grouped = overlap_links(df, shared_group=True).collect()
    assert len(grouped) == sum(len(x) * len(y) for t in texts for x, y in [*groups_of(*vocabularies(t))])


def test_slices_change_nothing(spark, vocabularies, monkeypatch):
    text = "".join(f"word{i % 7} and other's text, {i} " for i in range(400))
    assert len(slices(text, 50)) > 50 and " ".join(slices(text, 50)) == text
    a, b = tokenlinks.byte_vocabulary(BYTE_BPE), tokenlinks.piece_vocabulary(PIECE_BPE)
    assert a.cuts and b.cuts
    for v, k in ((a, 0), (b, 1)):
        want = [i for i, *_ in vocabularies(text)[k]]
        assert [i for s in slices(text, 50) for i in v.encode([s])[0]] == want


def test_a_long_text_slice_by_slice(monkeypatch):
    a, b = tokenlinks.byte_vocabulary(BYTE_BPE), tokenlinks.piece_vocabulary(PIECE_BPE)
    text = "".join(f"word{i % 7} and other's text,\n {i} " for i in range(400))
    monkeypatch.setattr(tokenlinks.slices, "__defaults__", (50,))
    for t in (text, text + "▁"):
        whole, parts = tokenlinks._chunk(a, b, [t]), tokenlinks._long_text(a, b, t)
        assert len(slices(t)) > 50 and bool(whole.numbers.any()) == (t == text)
        for x, y in zip(whole, parts):
            assert np.array_equal(x, y)


def test_both_encoders_of_a_vocabulary_agree():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    fast = tokenlinks._ranked(BYTE_BPE, tokenlinks.byte_vocabulary(BYTE_BPE).token_bytes)
    assert fast is not None
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x180)]]
    rnd = random.Random(8)
    for _ in range(3000):
        text = " " + "".join(rnd.choice(letters if rnd.random() < 0.5 else "aeiou 's'll19 \n.,") for _ in range(rnd.randint(0, 120)))
        assert tokenlinks._plain(text) and fast(text) == t.encode(text, add_special_tokens=False).ids
    assert not any(tokenlinks._plain(x) for x in ("日本", "x" * 400, " " * 400, "\x1c", "\u00a0", "\u0180"))


def test_no_documents(spark):
    per_text, pairs = align_tokens(spark.createDataFrame([], SCHEMA))
    assert per_text.count() == pairs.count() == 0
