"""Bucketed tables rewrite what a change touches; point files are read by device."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.sources import files, store
from sensorloom.sources.buckets import BucketTable

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
SCHEMA = "device_id long, mesh_id string, n long"


def test_a_batch_rewrites_its_buckets(spark, tmp_path):
    r = random.Random(3)
    table = BucketTable(str(tmp_path / "t"), SCHEMA, buckets=64)
    want = {i: 0 for i in range(500)}
    table.start(spark.createDataFrame([(i, "m", 0) for i in want], SCHEMA))
    before = table.writes(spark)
    assert len(before) == 64
    for batch in range(1, 4):
        ids = r.sample(range(600), 10) + [None]
        keys = spark.createDataFrame([(i,) for i in ids], "device_id long")

        def change(rows, keys=keys, batch=batch):
            found = keys.where("device_id is not null").withColumn("fresh", F.lit(True))
            both = rows.join(found, "device_id", "full_outer")
            both = both.where(~(F.col("device_id") % 50 == 7) | F.col("fresh").isNull())  # some go
            return both.select("device_id", F.lit("m").alias("mesh_id"), F.when(F.col("fresh"), batch).otherwise(F.col("n")).cast("long").alias("n"))

        version = table.advance(keys, change)
        for i in ids[:-1]:
            want[i] = batch
            if i % 50 == 7:
                del want[i]
        now = table.writes(spark)
        assert version == batch and sum(before.get(b) != now.get(b) for b in range(64)) <= len(ids)
        before = now
        assert {x.device_id: x.n for x in table.read(spark).collect()} == want
    assert {x.device_id: x.n for x in table.read(spark, 0).collect()} == {i: 0 for i in range(500)}  # older readers
    assert table.advance(keys.limit(0), lambda rows: pytest.fail("changed")) == 3
    with pytest.raises(ValueError, match="other keys"):
        table.advance(spark.createDataFrame([(1,)], "device_id long"), lambda rows: rows.withColumn("device_id", F.col("device_id") + 1))
    assert {x.device_id: x.n for x in table.read(spark).collect()} == want
    assert table.sweep(spark, keep=1) > 0 and {x.device_id: x.n for x in table.read(spark).collect()} == want
    assert sum(len([n for n in files.names(spark, f"{table.path}/data/{w}") if "=" in n]) for w in files.names(spark, f"{table.path}/data")) == len(table.writes(spark))


def test_empty_start(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), SCHEMA)
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    table.start(spark.createDataFrame([], SCHEMA))
    assert table.read(spark).collect() == []


def test_rows_read_fall_with_the_devices_asked(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.lit("m").alias("mesh_id"), (F.col("id") % 500).alias("node_id"), F.lit("env").alias("measurement"), F.lit("t").alias("field"),
        F.lit("env.t").alias("channel"), F.col("id").cast("double").alias("value"), F.lit("double").alias("value_type"), F.col("id").alias("packet_id"),
        F.timestamp_seconds(F.lit(int(NOON.timestamp())) + F.col("id") / 1000).alias("time"),
    )
    points = rows.select(*[
        F.col(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in (c.rsplit(" ", 1) for c in schemas.POINT.replace("map<string,string>", "map<string;string>").split(", "))
        for k in [k.replace(";", ",")]
    ])
    path = str(tmp_path / "points")
    store.write_points(points.repartition(4), path, 1)

    def read(nodes):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = store.read_channel(store.read_points(spark, path, deduplicate=False), "env.t", NOON - timedelta(days=1), nodes=nodes)
            n = len(df.collect())
            leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
            return n, leaf.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    assert read(None) == (200_000, 200_000)
    found, scanned = read([17])
    assert found == 400 and scanned <= 40_000
    assert read([100_000])[0] == 0
