"""Drift of scores against their own history, in a stream and in a table.

A score is (dimension_id, persona_id, score_id, at timestamp, score). Each is compared with all scores of
its dimension that came before, by time and then id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import ranks

# Scores that a history needs, the z-score below which there is drift, and the least spread.
LEAST_HISTORY, DRIFT_Z, LEAST_STD = 3, -1.0, 0.01

CHECKED = "dimension_id string, persona_id string, score_id string, at timestamp, score double, history bigint, status string, z_score double, mean double, std double"
ARROW = pa.schema([("persona_id", pa.string()), ("score_id", pa.string()), ("at", pa.timestamp("us")), ("score", pa.float64())])
BATCH_ROWS = 65536
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _History(StatefulProcessor):
    """Per dimension: count, mean and sum of squared distances, whatever the number of scores; a dimension
    without scores for ``idle`` is forgotten by a timer."""

    def __init__(self, idle: timedelta | None) -> None:
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("history", "n bigint, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        # one batch of one dimension, kept as Arrow columns
        new = pa.concat_tables(pa.Table.from_pandas(r[["persona_id", "score_id", "at", "score"]], ARROW, preserve_index=False) for r in rows)
        new = new.sort_by([("at", "ascending"), ("score_id", "ascending")])
        score = new["score"].to_numpy()
        # sums before each score of its distance from a fixed value near to all, so that little cancels out
        near = mean if n else score[0]
        off = score - near
        before = n + np.arange(len(score) + 1)
        least = np.maximum(before, 1)
        total, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (off, off * off))
        means, m2s = near + total / least, np.maximum(m2 + squares - total * total / least, 0.0)
        self.state.update((int(before[-1]), float(means[-1]), float(m2s[-1])))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            last = max(pc.max(new["at"]).cast(pa.int64()).as_py() / 1000, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(int(last + self.idle.total_seconds() * 1000))
        history, means, stds = before[:-1], means[:-1], np.sqrt(m2s[:-1] / least[:-1])
        known = history >= LEAST_HISTORY
        z = (score - means) / np.maximum(stds, LEAST_STD)
        status = np.where(known, np.where(z < DRIFT_Z, "drift_detected", "stable"), "insufficient_data")
        for low in range(0, len(score), BATCH_ROWS):
            here = slice(low, low + BATCH_ROWS)
            part = new.slice(low, BATCH_ROWS).to_pandas()
            part.insert(0, "dimension_id", key[0])
            numbers = {k: np.where(known[here], x[here], np.nan) for k, x in (("z_score", z), ("mean", means), ("std", stds))}
            yield part.assign(history=history[here], status=status[here], **numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in CHECKED.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs; a query keeps the one that it was started with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def monitor(scores: DataFrame, late: str = "1 minute", idle: timedelta | None = None) -> DataFrame:
    """``CHECKED`` rows of a stream of scores; start it within :func:`rocksdb`. Scores later than ``late``
    are dropped; the state is three numbers for each dimension heard of within ``idle``."""
    d = scores.withWatermark("at", late).select("dimension_id", "persona_id", "score_id", "at", "score")
    return d.groupBy("dimension_id").transformWithStateInPandas(_History(idle), CHECKED, "Append", "EventTime")


def check_drift(scores: DataFrame) -> DataFrame:
    """``CHECKED`` rows of a table of scores: running counts, sums and sums of squares, by ranges of time."""
    d = scores.select("dimension_id", "persona_id", "score_id", "at", "score").withColumns({"one": F.lit(1).cast("bigint"), "square": F.col("score") * F.col("score")})
    r = ranks.running(d, ["dimension_id"], ["at", "score_id"], "one", "score", "square")
    n = F.col("before_one")
    mean = F.when(n > 0, F.col("before_score") / F.greatest(n, F.lit(1)))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("before_square") / F.greatest(n, F.lit(1)) - mean * mean))
    enough = n >= LEAST_HISTORY
    z = F.when(enough, (F.col("score") - mean) / F.greatest(std, F.lit(LEAST_STD)))
    status = F.when(~enough, "insufficient_data").when(z < DRIFT_Z, "drift_detected").otherwise("stable")
    only: dict[str, Column] = {"z_score": z, "mean": F.when(enough, mean), "std": F.when(enough, std)}
    return r.select("dimension_id", "persona_id", "score_id", "at", "score", n.alias("history"), status.alias("status"), *(c.alias(k) for k, c in only.items()))


def alerts(checked: DataFrame, suite: str = "persona") -> DataFrame:
    """(persona_id, suite, dimension_id, dropped, line) for each score that drifted."""
    dropped = F.round(F.abs("z_score"), 2)
    line = F.format_string("  %s: dropped by %.2f", F.col("dimension_id"), dropped)
    return checked.where("status = 'drift_detected'").select("persona_id", F.lit(suite).alias("suite"), "dimension_id", "score_id", dropped.alias("dropped"), line.alias("line"))
