"""Toxicity by compression distance: the same windows under a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import text_of

WINDOW = 32  # words that are compressed together
LONGEST = 64  # bytes of a word; a longer one is cut
GRAM = 5  # bytes of the pieces by which toxic and ordinary training texts are told apart
LEVEL = 16
BASE_BYTES, TOXIC_BYTES = 65536, 4096
LOW, HIGH = -3, 8  # gains, in bytes, beyond which all count alike
FOLDS = 5


class ToxicityModel(NamedTuple):
    ordinary: bytes  # dictionaries, equally long and alike but for their ends
    toxic: bytes
    evidence: list[float]  # logarithm of how much likelier a gain is in a toxic text, from LOW to HIGH
    weights: list[float]  # of the features of a text
    prior: float | None  # the only score, if one of the classes is unknown


def words_of(text: str) -> list[bytes]:
    found = text.encode().lower().split()
    if any(len(w) > LONGEST for w in found):
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def windows_of(text: str) -> list[bytes]:
    """The whole text in runs of WINDOW words; one empty window without words."""
    ws = words_of(text)
    return [b" " + b" ".join(ws[i:i + WINDOW]) + b" " for i in range(0, len(ws), WINDOW)] or [b""]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **plain)


class Scorer:
    """A model with its compressors, for one task."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.pair = (_compressor(model.ordinary), _compressor(model.toxic))
        self.evidence = np.array(model.evidence)

    def gains(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window, cut to LOW..HIGH."""
        ordinary, toxic = (c.compress for c in self.pair)
        return np.clip([len(ordinary(w)) - len(toxic(w)) for w in windows_of(text)], LOW, HIGH)

    def features(self, gains: np.ndarray) -> np.ndarray:
        e = self.evidence[gains - LOW]
        return np.array([np.arcsinh(e.sum()), np.sort(e)[-3:].sum(), np.log1p(len(e)), 1.0])

    def score(self, text: str) -> tuple[float, int]:
        """Score and number of windows."""
        if self.model.prior is not None:
            return self.model.prior, len(windows_of(text))
        gains = self.gains(text)
        return float(_logistic(self.features(gains) @ np.array(self.model.weights))), len(gains)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _grams(text: str) -> np.ndarray:
    """The distinct GRAM-byte pieces of a text's words, spaces around them included, as numbers."""
    b = np.frombuffer(b" " + b" ".join(words_of(text)) + b" ", np.uint8).astype(np.int64)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    columns = [b[i:len(b) - GRAM + 1 + i] for i in range(GRAM)]
    within = np.all([c != 32 for c in columns[1:-1]], axis=0)  # of one word
    return np.unique(sum(c << (8 * i) for i, c in enumerate(columns))[within])


def _telling(toxic: Sequence[str], ordinary: Sequence[str], lift: float = 4.0, most: int = 400) -> list[bytes]:
    """Pieces that toxic texts have and ordinary ones do not.

    One after another the piece is taken that most toxic texts have, less the share of ordinary ones; a text counts
    half for each piece of it already taken, so that a group of copies brings in its pieces once.
    """
    own = [_grams(t) for t in toxic]
    pieces, n = np.unique(np.concatenate(own), return_counts=True)
    other, m = np.unique(np.concatenate([_grams(t) for t in ordinary]), return_counts=True)
    at = np.minimum(np.searchsorted(other, pieces), len(other) - 1) if len(other) else np.zeros(len(pieces), np.int64)
    among = np.where(other[at] == pieces, m[at], 0) if len(other) else np.zeros(len(pieces), np.int64)
    least = max(6.0, 0.005 * len(toxic))
    good = (n >= least) & (n / len(toxic) > lift * (among + 1) / len(ordinary))
    pieces, penalty = pieces[good], among[good] * len(toxic) / len(ordinary)
    flat = np.concatenate(own)
    kept = np.isin(flat, pieces)
    text = np.repeat(np.arange(len(own)), [len(g) for g in own])[kept]
    place = np.searchsorted(pieces, flat[kept])
    order = np.argsort(place, kind="stable")
    text, bounds = text[order], np.searchsorted(place[order], np.arange(len(pieces) + 1))
    weight, chosen, place = np.ones(len(own)), [], place[order]
    while len(pieces) and len(chosen) < most:
        worth = np.bincount(place, weight[text], len(pieces)) - penalty
        best = int(worth.argmax())
        if worth[best] < least:
            break
        chosen.append(int(pieces[best]).to_bytes(GRAM, "little"))
        weight[text[bounds[best]:bounds[best + 1]]] /= 2
        penalty[best] = np.inf
    return chosen


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few of them are one themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def _around(pieces: list[bytes], texts: Sequence[str]) -> list[bytes]:
    """The words of the texts that hold one of the pieces, with their spaces."""
    if not pieces:
        return []
    found = re.compile(b"|".join(map(re.escape, sorted(pieces, key=len, reverse=True))))
    out = []
    for t in texts:
        whole, end = b" " + b" ".join(words_of(t)) + b" ", 0
        for hit in found.finditer(whole):
            if hit.start() >= end:
                begin = whole.rfind(b" ", 0, hit.start() + 1)
                end = whole.find(b" ", max(begin + 1, hit.end() - 1)) + 1
                out.append(whole[begin:end])
    return out


def fit_model(toxic: Sequence[str], ordinary: Sequence[str], rate: float) -> ToxicityModel:
    """A model from sample texts of both classes; ``rate`` is the share of toxic ones where it will be used.

    Three quarters of each class make the dictionaries. Both begin with one trained on ordinary windows. The toxic
    one goes on with one trained on the words by which toxic texts differ, the ordinary one with as many empty bytes, so
    that windows without such words are coded alike and a gain in bytes comes from toxic text only. The last quarter
    calibrates: how much each gain says, and the weights of a text's features by logistic regression.
    """
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", [], [], 1.0 if toxic else 0.0)
    quarter = lambda xs: (xs[len(xs) // 4:], xs[:len(xs) // 4] or xs)
    (toxic, check_toxic), (ordinary, check_ordinary) = quarter(list(toxic)), quarter(list(ordinary))
    base = _trained(BASE_BYTES, [w for t in ordinary for w in windows_of(t)])
    samples = _around(_telling(toxic, ordinary), toxic)
    end = _trained(TOXIC_BYTES, samples) if samples else b""
    model = ToxicityModel(base + bytes(len(end)), base + end, [], [], None)
    scorer = Scorer(model)
    gains = [scorer.gains(t) for t in [*check_toxic, *check_ordinary]]
    label = np.repeat([1.0, 0.0], [len(check_toxic), len(check_ordinary)])
    seen = [1.0 + np.bincount(np.concatenate([g for g, is_toxic in zip(gains, label) if is_toxic == k]) - LOW, minlength=HIGH - LOW + 1) for k in (1, 0)]
    scorer.evidence = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
    x = np.array([scorer.features(g) for g in gains])
    weight = np.where(label == 1, rate / len(check_toxic), (1 - rate) / len(check_ordinary)) * len(label)
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps with a small ridge
        p = _logistic(x @ beta)
        slope = x.T @ (weight * (label - p)) - 0.01 * beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta)), slope)
    return model._replace(evidence=scorer.evidence.tolist(), weights=beta.tolist())


def held_out(doc_id: Column) -> Column:
    """Whether a row must not be learned from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_toxic: int = 2000, sample_ordinary: int = 6000, sample_bytes: int = 100_000) -> ToxicityModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    The sample has at most ``sample_toxic`` and ``sample_ordinary`` labelled ids, the first by a digest of the id, and
    of them the whole texts of at most ``sample_bytes`` bytes. Only the ids' labels are ordered, and only the sample is
    brought to the driver; the classes' sizes are counted over all labels. An id with both labels counts as toxic, an id
    with several texts gives its first; equal texts count once. Without one of the classes the model has one score, 0
    or 1.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = lambda kind, most: known.filter(F.col("toxic") == kind).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most)
    chosen = first(1, sample_toxic).unionByName(first(0, sample_ordinary))
    texts = docs.select("doc_id", text_of().alias("text")).filter(F.octet_length("text") <= sample_bytes)
    # at most sample_toxic + sample_ordinary rows
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted((str(r["_id"]), r["toxic"], r["text"]) for r in sample.collect())
    of = {k: list(dict.fromkeys(t for _, toxic, t in rows if toxic == k)) for k in (0, 1)}
    return fit_model(of[1], of[0], n.get(1, 0) / max(1, sum(n.values())))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_windows`` for every whole text.

    A text is cut into windows of ``WINDOW`` words; each is compressed with both dictionaries, and what the gains say
    together, what the three loudest say and the number of windows give the score. Rows stay where they are. A null
    text counts as an empty one, which has one empty window and a score; a null id is held out. A very long text is
    one row's work, with one small number a window in memory. Equal texts have equal scores; repeated rows stay. An
    empty table gives an empty result; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "n_windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, n_windows long")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_windows")
