"""User aggregates whose states merge, for metrics that are not sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.sources.readers import stored

FAN = 64  # states that one task merges in a step
HELD = 1024  # slices whose states a task holds at once; more are passed on early


class Metric(Protocol):
    """A metric over rows of a slice by way of a state that is small beside the rows."""

    def update(self, state: Any, rows: pd.DataFrame) -> Any:
        """The state after some more rows; ``state`` is None at the start."""

    def merge(self, one: Any, other: Any) -> Any:
        """The state of two sets of rows together; order must not matter."""

    def finish(self, state: Any) -> dict[str, float | None]:
        """The metrics of a slice."""


def _partial(metric: Metric, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def out(states: dict[Any, Any]) -> pd.DataFrame:
        return pd.DataFrame({key: list(states), "state": [cloudpickle.dumps(s) for s in states.values()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[Any, Any] = {}
        for b in batches:
            for k, rows in b.groupby(key, sort=False, dropna=False):
                k = None if pd.isna(k) else k
                states[k] = metric.update(states.get(k), rows)
            if len(states) > HELD:
                yield out(states)
                states = {}
        if states:
            yield out(states)

    return run


def _merged(metric: Metric, states: list[bytes]) -> Any:
    whole = cloudpickle.loads(states[0])
    for s in states[1:]:
        whole = metric.merge(whole, cloudpickle.loads(s))
    return whole


def aggregate_by(df: DataFrame, key: str, metric: Metric, results: Sequence[str], fan: int = FAN) -> DataFrame:
    """``key`` and the named results of any mergeable user metric, one row per slice; a null key is a slice.

    Every task folds its rows into one state per slice. States then meet ``fan`` at a time, step by step, until each
    slice has one: a slice of any size never stands in one task, and a group holds about ``fan`` states. Each step is
    written to the shared folder, so a lost executor costs a step. Rows must fold in any order.
    """
    kind = df.schema[key].dataType.simpleString()
    part = stored(df.mapInPandas(_partial(metric, key), f"`{key}` {kind}, state binary"), "states")
    most = part.groupBy(key).count().agg(F.max("count")).first()[0] or 0

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: rows[key].iloc[:1], "state": [cloudpickle.dumps(_merged(metric, rows["state"].tolist()))]})

    while most > 1:
        nodes = -(-most // fan)
        # a hash deals states about evenly; the place tells equal states apart
        dealt = part.withColumn("_node", F.pmod(F.xxhash64("state", F.monotonically_increasing_id()), F.lit(nodes)))
        part = stored(dealt.groupBy(key, "_node").applyInPandas(merge, f"`{key}` {kind}, state binary"), "states")
        most = nodes

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [metric.finish(cloudpickle.loads(s)) for s in b["state"]]
            yield pd.DataFrame({key: b[key], **{r: [f[r] for f in found] for r in results}})

    return part.mapInPandas(finish, f"`{key}` {kind}, " + ", ".join(f"`{r}` double" for r in results))


class ScoreHistogram:
    """Median and AUROC of scores in 0 to 1 from counts of both classes in equal bins.

    Exact for scores that are multiples of ``1 / bins``, as after rounding; otherwise off by a bin at most. The median is the
    lower one. Rows without a score do not count; AUROC needs both classes.
    """

    def __init__(self, score: str, label: str, bins: int = 1000):
        self.score, self.label, self.bins = score, label, bins

    def update(self, state: np.ndarray | None, rows: pd.DataFrame) -> np.ndarray:
        state = np.zeros((2, self.bins + 1), np.int64) if state is None else state
        rows = rows[rows[self.score].notna()]
        at = np.rint(rows[self.score].to_numpy(np.float64) * self.bins).astype(np.int64)
        for y in (0, 1):
            state[y] += np.bincount(at[(rows[self.label] == y).to_numpy()], minlength=self.bins + 1)
        return state

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one + other

    def finish(self, state: np.ndarray) -> dict[str, float | None]:
        total = np.cumsum(state.sum(0))
        n = int(total[-1])
        median = float(np.searchsorted(total, (n + 1) // 2)) / self.bins if n else None
        neg, pos = int(state[0].sum()), int(state[1].sum())
        below = np.cumsum(state[0]) - state[0]
        wins = int((state[1] * below).sum()) + int((state[1] * state[0]).sum()) / 2
        return {"median": median, "auroc": wins / neg / pos if neg and pos else None}
