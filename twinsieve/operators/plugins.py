"""Hooks for user code: scorers over texts and metrics over slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[tuple[float, float]]]


def score_texts(df: DataFrame, ident: str, text: str, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """Score texts with a user model: ``(ident, logp_benign, logp_injection, p_safe)``.

    ``make_scorer`` runs once per task (load the model there); the scorer sees one Arrow batch at a time. A NULL or
    empty text is an error, as a score for it would look like any other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for b in batches:
            if len(b):
                pair = np.asarray(score(b[text].tolist()), dtype=np.float64)
                gap = pair[:, 1] - pair[:, 0]
                yield pd.DataFrame({ident: b[ident], "logp_benign": pair[:, 0], "logp_injection": pair[:, 1], "p_safe": 1.0 / (1.0 + np.exp(gap))})

    body = F.when(F.length(text) > 0, F.col(text)).otherwise(F.raise_error(F.lit("there is a row without a text to score")).cast("string"))
    return df.select(ident, body.alias(text)).mapInPandas(run, f"{ident} bigint, logp_benign double, logp_injection double, p_safe double")


def metric_by(df: DataFrame, key: str, partial: Callable[[pd.DataFrame], dict[str, float]], parts: Sequence[str], finish: dict[str, Column]) -> DataFrame:
    """A user metric per slice, in two steps so that no slice has to fit into one task.

    ``partial`` turns some rows of one slice into named sums, ``parts`` lists their names, and
    ``finish`` gives the metrics as expressions over the added-up sums.
    """
    schema = f"{key} string, " + ", ".join(f"{p} double" for p in parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **partial(g)} for k, g in b.groupby(key, sort=False)]
            if rows:
                yield pd.DataFrame(rows)[[key, *parts]]

    sums = df.mapInPandas(run, schema).groupBy(key).agg(*[F.sum(p).alias(p) for p in parts])
    return sums.select(key, *[c.alias(n) for n, c in finish.items()])
