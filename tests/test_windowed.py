"""Windowed functions in slices against plain loops."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import windowed as W

BASE = 1_704_067_200
SCHEMA = "mesh string, node long, n long, time timestamp, value double, seconds double, alpha double"


def series(seed):
    """Series of very different length and density, with nulls, ties and gaps."""
    r = random.Random(seed)
    rows = []
    for node in (None, 1, 2, 3, 4):
        at, n = 0.0, {1: 400, 2: 1, 3: 60}.get(node, 25)
        for _ in range(n):
            at += r.choice((0, 0.5, 1, 7, 60, 600)) if node != 4 else 90
            value = r.choice((None, float("nan"), float("inf"))) if r.random() < 0.05 else r.uniform(-50, 50)
            rows.append((r.choice("mm") if node != 3 else None, node, len(rows), datetime.fromtimestamp(BASE + at, timezone.utc), value,
                         {1: 30.0, 3: 500.0, 4: None}.get(node, 3.5), {1: 0.2, 3: 1.0, 4: 2.0}.get(node, 0.7)))
    rows.append(("m", 1, len(rows), None, 1.0, 30.0, 0.2))
    return rows


def usable(rows):
    out = {}
    for row in rows:
        if row[3] is not None and row[4] is not None and abs(row[4]) < float("inf"):
            out.setdefault(row[:2], []).append(row)
    return {k: sorted(v, key=lambda x: (x[3], x[2])) for k, v in out.items()}


def model(rows):
    want = {}
    for mine in usable(rows).values():
        smooth = None
        for i, (_, _, n, t, x, seconds, alpha) in enumerate(mine):
            near = [y[4] for y in mine if seconds and 0 <= (t - y[3]).total_seconds() < seconds] if seconds else []
            near += [y[4] for y in mine if seconds and y[3] > t and y[3] == t]
            mean = sum(near) / len(near) if near else None
            gap = (t - mine[i - 1][3]).total_seconds() if i else 0
            rate = (x - mine[i - 1][4]) / gap if gap > 0 else None
            smooth = None if not 0 < alpha <= 1 else x if smooth is None else alpha * x + (1 - alpha) * smooth
            want[n] = (mean, rate, smooth)
    return want


@pytest.mark.parametrize("width", [1, 10, 86_400])
def test_windowed_functions(spark, width):
    rows = series(width)
    frame = spark.createDataFrame(rows, SCHEMA)
    keys, order = ("mesh", "node"), ("n",)
    got = [
        W.rolling_mean(frame, keys, F.col("seconds"), width_seconds=width, into="y"),
        W.rate_of_change(frame, keys, order=order, width_seconds=width, into="y"),
        W.exponential_smoothing(frame, keys, F.col("alpha"), order=order, width_seconds=width, into="y"),
    ]
    want = model(rows)
    for i, found in enumerate(got):
        assert found.columns == [*frame.columns, "y"]
        found = {r.n: r.y for r in found.collect()}
        assert set(found) == set(want)
        for n, y in found.items():
            assert (y is None) == (want[n][i] is None) and (y is None or abs(y - want[n][i]) < 1e-9), (i, n, y, want[n][i])


def test_smoothing_takes_batches_of_slices(spark):
    """Slices go through Python a batch at a time, not a call each, and slices longer than a batch go on across it."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("node"), "id", F.timestamp_micros(F.col("id") * 500_000).alias("time"), (F.col("id") * 37 % 101).cast("double").alias("value")
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = W.exponential_smoothing(rows, ("node",), 0.2, order=("id",), width_seconds=600, into="y")
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.y for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    smooth = {}
    for i in range(3000):
        x = float(i * 37 % 101)
        smooth[i % 3] = 0.2 * x + 0.8 * smooth[i % 3] if i >= 3 else x
        assert abs(got[i] - smooth[i % 3]) < 1e-9


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert W.rolling_mean(frame, ("node",), 5).collect() == [] and W.rate_of_change(frame, ("node",)).collect() == []
    assert W.exponential_smoothing(frame, ("node",), 0.5).collect() == []
