"""Drift: the table against a plain loop, the stream with late and idle dimensions."""

import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.streaming import monitor

DDL = "dimension_id string, persona_id string, score_id string, at timestamp, score double"
BEGIN = datetime(2024, 1, 1)


def rows(dimension, scores, hours=1, first=0):
    return [(dimension, f"p{i % 3}", f"{first + i:04}", BEGIN + timedelta(hours=hours * (first + i)), s) for i, s in enumerate(scores)]


def plain(scores):
    out = []
    for i, s in enumerate(scores):
        h = scores[:i]
        if len(h) < 3:
            out.append(("insufficient_data", None))
            continue
        mean = sum(h) / len(h)
        std = math.sqrt(sum((x - mean) ** 2 for x in h) / len(h))
        z = (s - mean) / max(std, 0.01)
        out.append(("drift_detected" if z < -1.0 else "stable", pytest.approx(z, abs=1e-6)))
    return out


SCORES = {"D1": [0.9, 0.8, 0.85, 0.86, 0.2, 0.9, 0.95], "D2": [0.5] * 5 + [0.485, 0.5], "D3": [1.0, 0.0], "D4": [0.7, 0.7, 0.7, 0.69]}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["dimension_id"], r["at"], r["score_id"])):
        out.setdefault(r["dimension_id"], []).append((r["status"], r["z_score"]))
    return out


def test_table_against_a_plain_loop(spark):
    d = spark.createDataFrame([x for k, s in SCORES.items() for x in rows(k, s)], DDL).repartition(3)
    checked = monitor.check_drift(d)
    assert found(checked) == {k: plain(s) for k, s in SCORES.items()}
    got = {(r["dimension_id"], r["persona_id"]): (r["dropped"], r["line"]) for r in monitor.alerts(checked).collect()}
    assert set(got) == {("D1", "p1"), ("D2", "p2")} and got["D2", "p2"] == (1.5, "  D2: dropped by 1.50")


def test_empty_table(spark):
    assert monitor.check_drift(spark.createDataFrame([], DDL)).count() == 0


def test_stream_in_parts_and_idle_dimensions(spark, tmp_path):
    """Three batches; a dimension that is idle for a day begins anew, the others go on."""
    parts = [
        rows("D1", [0.9, 0.8, 0.85]) + rows("idle", [0.5, 0.5, 0.5, 0.5]),
        rows("D1", [0.86, 0.2], first=3) + rows("D1", [0.9], first=60),
        rows("D1", [0.8], first=100) + rows("idle", [0.1], first=101),
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DDL).parquet(source)
        with monitor.rocksdb(spark):
            q = monitor.monitor(stream, idle=timedelta(days=1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()
        assert spark.read.parquet(out).count() == sum(map(len, parts[: i + 1]))
    got = found(spark.read.parquet(out))
    assert got["D1"] == plain([0.9, 0.8, 0.85, 0.86, 0.2, 0.9, 0.8])
    assert got["idle"] == [*plain([0.5] * 4), ("insufficient_data", None)]  # its history was forgotten
    assert spark.conf.get(monitor.STORE, "") != monitor.ROCKSDB
    assert spark.read.parquet(out).where(F.col("history") == 0).count() == 3


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_batch_is_scored_by_columns():
    """Two batches in pieces and out of order give what a loop over single scores gives, in frames of
    bounded size; a large common offset cancels nothing out."""
    scores = [1e6 + (i * 7919 % 101) / 10 for i in range(2 * monitor.BATCH_ROWS + 10)]
    d = pd.DataFrame([(p, k, at, s) for _, p, k, at, s in rows("D", scores, hours=1 / 60)], columns=["persona_id", "score_id", "at", "score"])
    h, cut, got = monitor._History(None), len(d) // 3, []
    h.state = _State()
    for part in (d[:cut], d[cut:]):
        pieces = [x.sample(frac=1, random_state=1) for x in (part[1::2], part[::2])]
        made = list(h.handleInputRows(("D",), iter(pieces), None))
        assert max(map(len, made)) <= monitor.BATCH_ROWS
        got += made
    got = pd.concat(got)
    assert list(got.columns) == [c.split()[0] for c in monitor.CHECKED.split(", ")]
    n, mean, m2 = 0, 0.0, 0.0
    for i, (s, status, z) in enumerate(zip(got["score"], got["status"], got["z_score"], strict=True)):
        assert s == scores[i]
        if n < 3:
            assert status == "insufficient_data" and math.isnan(z)
        else:
            assert z == pytest.approx((s - mean) / max(math.sqrt(m2 / n), 0.01), abs=1e-6)
        n, step = n + 1, s - mean
        mean += step / n
        m2 += step * (s - mean)
    assert list(got["history"]) == list(range(len(scores)))
