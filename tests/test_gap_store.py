"""Stored hourly summaries give what reading everything anew gives."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sensorloom.operators.quality import CHANNEL
from sensorloom.operators.sliced import gap_summary
from sensorloom.plans.gap_store import GapStore

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
SCHEMA = "mesh_id string, node_id long, channel string, value double, value_type string, time timestamp"


def rows(seed, hours=30):
    r = random.Random(seed)
    out = []
    for node in range(4):
        for _ in range((300, 40, 3, 0)[node]):
            at = NOON + timedelta(seconds=r.randint(-hours * 3_600, 3_600), microseconds=r.randint(0, 999_999))
            out.append(("m" if node else None, node, r.choice(("a.x", "b.x")), 1.0, "double", at))
    out += [("m", 1, "a.x", 1.0, "double", NOON - timedelta(hours=h)) for h in range(3)]  # on the borders
    return out


def test_scans_an_hour_apart(spark, tmp_path):
    table, asked = [rows(1)], []

    def read(session, start, stop):
        asked.append((start, stop))
        return session.createDataFrame(table[0], SCHEMA)

    gaps = GapStore(str(tmp_path / "g"), read)

    def scan(stop, lookback=timedelta(hours=24)):
        asked.clear()
        found = sorted(map(str, gaps.stats(spark, stop - lookback, stop).collect()))
        whole = spark.createDataFrame(table[0], SCHEMA).where((F.col("time") >= F.lit(stop - lookback)) & (F.col("time") < F.lit(stop)))
        assert found == sorted(map(str, gap_summary(whole, CHANNEL).collect()))
        return list(asked)

    hour = timedelta(hours=1)
    assert scan(NOON) == [(NOON - 24 * hour, NOON)]
    assert scan(NOON + hour) == [(NOON, NOON + hour)]  # the second scan reads one slice
    assert scan(NOON + hour) == []
    part = NOON + timedelta(minutes=20)
    assert scan(part) == [(part - 24 * hour, NOON - 23 * hour), (NOON, part)]  # only what is no whole hour
    assert scan(NOON + hour, timedelta(minutes=10)) == [(NOON + timedelta(minutes=50), NOON + hour)]
    # Late points are seen when their hour is read again.
    table[0] = table[0] + [("m", 2, "a.x", 1.0, "double", NOON - timedelta(minutes=90))]
    gaps.forget(int((NOON - 2 * hour).timestamp()) // 3_600)
    assert scan(NOON) == [(NOON - 2 * hour, NOON - hour)]
