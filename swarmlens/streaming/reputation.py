"""Reputation as a stream: each entity's score lives in the state of a query, with its last events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swarmlens.operators.reputation import HISTORY, INITIAL, MAX_DAYS, RATE

_HOUR_MS = 3_600_000
OUTPUT = "id {key}, score double, effective_weight double, n bigint, last_hours double, idle boolean"
STATE = "score double, n bigint, hours array<double>, impacts array<double>, confidences array<double>"


def applied(state: tuple, hours: float, impact: float, confidence: float) -> tuple[tuple, float]:
    """The state (score, n, last events) after one event, and the weight behind its mean."""
    score, n, h, i, c = state
    if h and hours - h[-1] >= 24:
        kept = math.exp(-RATE * (hours - h[-1]) / 24)
        score = max(0.0, min(1.0, score * kept + INITIAL * (1 - kept)))
    h, i, c = [*h, hours][-HISTORY:], [*i, impact][-HISTORY:], [*c, confidence][-HISTORY:]
    weights = [math.exp(-(hours - x) / 168) * y if hours - x <= MAX_DAYS * 24 else 0.0 for x, y in zip(h, c)]
    weight = sum(weights)
    mean = sum(w * x for w, x in zip(weights, i)) / weight if weight > 0 else 0.0
    return (max(0.0, min(1.0, score + mean)), n + 1, h, i, c), weight


def _updates(idle_days: float):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else (INITIAL, 0, [], [], [])
        own = (own[0], own[1], list(own[2]), list(own[3]), list(own[4]))
        if state.hasTimedOut:
            state.remove()  # idle for so long that nothing of it counts any more
            yield pd.DataFrame({"id": [key[0]], "score": [own[0]], "effective_weight": [0.0], "n": [own[1]], "last_hours": [own[2][-1] if own[2] else 0.0], "idle": [True]})
            return
        weight = 0.0
        for hours, _, impact, confidence in sorted((r for f in frames for r in zip(f["hours"], f["factor"].fillna(""), f["impact"], f["confidence"])), key=lambda r: r):
            own, weight = applied(own, hours, impact, confidence)
        state.update(own)
        expires = int((own[2][-1] + 24 * idle_days) * _HOUR_MS)
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        yield pd.DataFrame({"id": [key[0]], "score": [own[0]], "effective_weight": [weight], "n": [own[1]], "last_hours": [own[2][-1]], "idle": [False]})

    return update


def scores(events: DataFrame, late: str = "0 seconds", idle_days: float = 2 * MAX_DAYS) -> DataFrame:
    """A row (id, score, effective_weight, n, last_hours, idle) for each entity and batch that has events (id, ts, factor, impact, confidence) of it.

    The state of an entity is its score, how many events it had and the last hundred of
    them.  A batch's events are applied in order of time, then factor, impact and confidence; those of a later
    batch should be later, as events are applied as they come.  An entity without events for ``idle_days``
    of event time is forgotten, with a last row that says so (``idle``).  Events without a
    time are left out; a null id is an entity like any other.
    """
    key = dict(events.dtypes)["id"]
    timed = events.where("ts IS NOT NULL").withWatermark("ts", late)
    timed = timed.withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return timed.groupBy("id").applyInPandasWithState(_updates(idle_days), OUTPUT.format(key=key), STATE, "update", GroupStateTimeout.EventTimeTimeout)


class ScoreTable:
    """The latest row of each entity, batch by batch: a batch that is run again replaces itself."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def take(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def latest(self) -> DataFrame:
        """(id, score, effective_weight, n) of the entities that are not idle, each from its last batch."""
        rows = self.spark.read.parquet(self.path)
        whole = F.struct("score", "effective_weight", "n", "idle")
        last = rows.groupBy("id").agg(F.max_by(whole, F.struct("batch", ~F.col("idle"))).alias("r"))
        return last.where("NOT r.idle").select("id", "r.score", "r.effective_weight", "r.n")
