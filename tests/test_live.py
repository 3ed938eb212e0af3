"""Configuration in levels, batches that become visible together, live registries."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.errors import StreamingQueryException

from sensorloom import schemas
from sensorloom.sources import files
from sensorloom.sources.commits import Commits, with_batch
from sensorloom.sources.levels import LevelTable
from sensorloom.streaming import ingest, jobs

from test_streaming import BASE, changes, envelope, moment, stream_of

SCHEMA = "key string, op string, value long, version long"


def folded(history):
    live = {}
    for key, op, value, version in sorted(history, key=lambda h: h[3]):
        if key:
            live[key] = None if op == "delete" else (value, version)
    return {k: v for k, v in live.items() if v}


def test_levels_follow_a_changelog(spark, tmp_path):
    r = random.Random(1)
    table, history, read = LevelTable(str(tmp_path / "t"), SCHEMA, fan_in=3), [], []
    keys = [f"k{i}" for i in range(30)] + ["", None]
    for batch in range(30):
        start = len(history)
        history += [(r.choice(keys), r.choice(("upsert", None, "delete")), r.randint(0, 99), start + i) for i in range(r.choice((0, 1, 20)))]
        asked = []

        def since(session, offset, asked=asked):
            asked.append(offset)
            return session.createDataFrame([h for h in history if offset is None or h[3] > offset], SCHEMA)

        version = table.catch_up(spark, since, batch)
        got = {x.key: (x.value, x.version) for x in table.read(spark, version).collect()}
        assert got == folded(history)
        # What a batch reads: new changes, and segments that don't grow with the history.
        new = len([h for h in history if asked[0] is None or h[3] > asked[0]])
        assert new <= 20 and len(version.segments) <= 2 * 4 and version.rows <= 30 * 4
        read.append(version)
        # The same batch again is given the same version and reads no changes.
        again = table.catch_up(spark, lambda *_: pytest.fail("read again"), batch)
        assert (again.number, again.segments) == (version.number, version.segments)
    earlier = read[-4]
    assert table.catch_up(spark, lambda *_: pytest.fail("read again"), 26).segments == earlier.segments
    # A writer that died leaves a segment no pointer names.
    table._write(spark.createDataFrame([("orphan", None, 1, 10**6)], SCHEMA), 0)
    assert {x.key for x in table.read(spark).collect()} == set(folded(history))
    assert table.sweep(spark, keep=1) > 0
    assert {x.key: (x.value, x.version) for x in table.read(spark).collect()} == folded(history)
    assert len(files.names(spark, str(tmp_path / "t/segments"))) == len(table.version(spark).segments)


def test_an_empty_changelog(spark, tmp_path):
    table = LevelTable(str(tmp_path / "t"), SCHEMA)
    assert table.read(spark).collect() == []
    table.catch_up(spark, lambda s, _: s.createDataFrame([], SCHEMA), 0)
    assert table.read(spark).collect() == [] and table.version(spark).offset is None


def test_a_pointer_is_written_once(spark, tmp_path):
    path = str(tmp_path / "p/000.json")
    files.create_text(spark, path, "first")
    with pytest.raises(Exception, match="exist"):
        files.create_text(spark, path, "second")
    assert files.read_text(spark, path) == "first" and files.names(spark, str(tmp_path / "p")) == ["000.json"] or [
        n for n in files.names(spark, str(tmp_path / "p")) if not n.startswith(".")
    ] == ["000.json"]


def test_ranges():
    ranges = []
    for n in (0, 1, 2, 5, 4, 9, 3, 3):
        ranges = with_batch(ranges, n)
    assert ranges == [[0, 5], [9, 9]]


def test_a_killed_batch_is_not_seen(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([envelope(i) for i in range(30)], schemas.ENVELOPE).write.parquet(source)
    load = ingest.config_from_changes(lambda s: changes(s))

    def die(table, batch):
        if table == "points":
            raise RuntimeError("killed")

    def start(**more):
        ingest.start_ingest(stream_of(spark, schemas.ENVELOPE, source), load, root, str(tmp_path / "cp"), **more).awaitTermination()

    read = lambda name, schema: ingest.read_table(spark, root, name, schema).count()
    with pytest.raises(StreamingQueryException):
        start(on_written=die)
    assert files.names(spark, f"{root}/points") and read("decoded", schemas.DECODED) == read("points", schemas.POINT) == read("drops", "packet_id long") == 0
    assert Commits(root).sweep(spark, ["decoded", "points", "drops"]) and not any(n.startswith("ingest") for n in files.names(spark, f"{root}/points"))
    start()
    assert read("decoded", schemas.DECODED) + read("drops", "packet_id long") == 30 and read("points", schemas.POINT) > 0
    assert Commits(root).sweep(spark, ["decoded", "points", "drops"]) == []


def test_notifications_with_a_registry_that_changes(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "sent")
    devices = spark.createDataFrame([("m", 1, "d1"), ("m", 2, "d2")], "mesh_id string, device_id long, label string").selectExpr("*", "'x' as name")
    meshes = spark.createDataFrame([("m", "o", "mesh", "ch")], "mesh_id string, owner_id string, label string, channel_id string")
    active = [False]

    def registry(session):
        owners = session.createDataFrame([("o", "n", "a@b", active[0])], "owner_id string, name string, email string, is_active boolean")
        return devices, meshes, owners

    def alarm(device, seconds):
        return ("m", device, "c", "absence", "stream", None, "x", moment(seconds))

    for is_active, rows in ((False, [alarm(1, 0), alarm(2, 0)]), (True, [alarm(1, 600), alarm(1, 900)]), (True, [alarm(1, 4100), alarm(1, 4200), alarm(2, 4000)]), (True, [])):
        active[0] = is_active
        spark.createDataFrame(rows, schemas.ALARM).coalesce(1).write.mode("append").parquet(source)
        jobs.start_notifications(stream_of(spark, schemas.ALARM, source), registry, path, str(tmp_path / "cp")).awaitTermination()
    got = sorted((x.device_id, int(x.triggered_at.replace(tzinfo=timezone.utc).timestamp()) - BASE) for x in spark.read.parquet(path).collect())
    # What nobody could be told starts no cool-down; the one of 600 holds until 4,200, over batches.
    assert got == [(1, 600), (1, 4200), (2, 4000)]
    assert isinstance(moment(0), datetime)


def test_one_file_is_taken_apart_by_many_tasks(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([envelope(i) for i in range(600)], schemas.ENVELOPE).coalesce(1).write.parquet(source)
    load = ingest.config_from_changes(changes)
    ingest.start_ingest(stream_of(spark, schemas.ENVELOPE, source), load, root, f"{root}/cp").awaitTermination()
    rows = spark.read.parquet(f"{root}/decoded")
    # A part writes a file; all of a single file's packets came in one part before.
    assert len(rows.inputFiles()) >= 8
    parts = spark.read.parquet(f"{root}/drops").unionByName(rows, allowMissingColumns=True)
    assert sorted(r.packet_id for r in parts.select("packet_id").collect()) == list(range(600))
