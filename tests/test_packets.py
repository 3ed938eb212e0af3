"""Packets, points, alarms, archive and units: small worked examples."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.units import QUALITY_FIELD_UNITS, quantity_kind
from sensorloom.operators import packets as K, points as P
from sensorloom.operators.calibrate import calibrate_events
from sensorloom.sources import feeds, store

MESH = "north-ridge"


def event(kind, payload, portnum=67, mesh=None, node=77, packet=1, channel="LF"):
    return (node, packet, portnum, 1704100800, 1, channel, "!c0de", mesh, kind, json.dumps(payload))


def points_of(spark, *events):
    rows = P.event_points(spark.createDataFrame(list(events), schemas.DECODED)).collect()
    found = {}
    for r in rows:
        value = r["value"] if r["value_type"] in ("double", "long") else r["value_bool"] if r["value_type"] == "bool" else r["value_str"]
        found.setdefault((r["packet_id"], r["measurement"]), {})[r["field"]] = value
    return found, rows


def test_telemetry_point(spark):
    found, rows = points_of(
        spark, event("telemetry:device_metrics", {"time": 1704100860, "device_metrics": {"battery_level": 61, "voltage": 4.12}})
    )
    assert found == {(1, "device_metrics"): {"packet_id": 1, "timestamp_quality": "payload", "battery_level": 61, "voltage": 4.12}}
    assert {r["time"].timestamp() for r in rows} == {1704100860}
    assert {r["mesh_id"] for r in rows} == {None}


def test_mesh_and_empty_tags(spark):
    _, rows = points_of(spark, event("telemetry:a", {"a": {"x": 1}}, mesh=MESH, channel=""))
    assert {(r["mesh_id"], r["channel_id"], r["gateway_id"]) for r in rows} == {(MESH, None, "!c0de")}


def test_telemetry_values_read_as_numbers(spark):
    payload = {"m": {"text_number": "12", "flag": True, "word": "x", "none": None, "list": [1], "suffix": "1d", "deep": {"a": 1}}}
    found, _ = points_of(spark, event("telemetry:m", payload))
    own = {k: v for k, v in found[(1, "m")].items() if k not in ("packet_id", "timestamp_quality")}
    assert own == {"text_number": 12.0, "flag": 1.0}


def test_several_sub_metrics_and_own_packet_id(spark):
    found, _ = points_of(
        spark,
        event("telemetry:device_metrics", {"device_metrics": {"battery_level": 33, "packet_id": 9}, "environment_metrics": {"temperature": -4.25}}),
    )
    assert set(found) == {(1, "device_metrics"), (1, "environment_metrics")}
    assert found[(1, "device_metrics")]["packet_id"] == 9


@pytest.mark.parametrize("clock, quality", [(0, "rx_time"), (1577836800, "rx_time"), (1577836801, "payload"), (None, "rx_time"), ("1704100860", "rx_time")])
def test_time_quality(spark, clock, quality):
    found, _ = points_of(spark, event("telemetry:a", {"time": clock, "a": {"x": 1}}))
    assert found[(1, "a")]["timestamp_quality"] == quality


def test_position_point(spark):
    found, _ = points_of(
        spark,
        event("position", {"latitude_i": -337500000, "longitude_i": 1512500000, "altitude": 58}, 3),
        event("position", {"altitude": None, "speed": 4}, 3, packet=2),
    )
    assert set(found) == {(1, "position")}
    assert found[(1, "position")]["latitude"] == pytest.approx(-33.75)
    assert found[(1, "position")]["longitude"] == pytest.approx(151.25)


def test_nodeinfo_point(spark):
    found, rows = points_of(
        spark,
        event("nodeinfo", {"id": "!0f1e2d", "long_name": "Weir gauge", "short_name": "WG", "role": ""}, 4),
        event("nodeinfo", {}, 4, packet=2),
    )
    assert found[(1, "nodeinfo")]["user_id"] == "!0f1e2d"
    assert rows[0]["tags"] == {"long_name": "Weir gauge", "short_name": "WG"}
    assert set(found[(2, "nodeinfo")]) == {"packet_id", "timestamp_quality"}


def test_generic_and_skipped_points(spark):
    found, rows = points_of(
        spark,
        event("portnum:99", {"depth_mm": 314, "ok": True, "remark": "silt", "inner": {"a": 1}}, 99),
        event("portnum:1", {"text": "good day"}, 1, packet=2),
        event("portnum:5", {"a": 1}, 5, packet=3),
        event("portnum:99", {"text": "only"}, 99, packet=4),
    )
    assert set(found) == {(1, "portnum_99")}
    own = {k: v for k, v in found[(1, "portnum_99")].items() if k not in ("packet_id", "timestamp_quality")}
    assert own == {"depth_mm": 314, "ok": True}
    assert {r["field"]: r["value_type"] for r in rows}["depth_mm"] == "long"


def alarm(spark, **values):
    columns = {"detector": "string", "mesh_id": "string", "device_id": "long", "node_id": "long", "channel": "string",
               "field": "string", "source": "string", "value": "double", "message": "string"}
    row = spark.createDataFrame(
        [tuple(values.get(c) for c in columns)], ", ".join(f"{c} {t}" for c, t in columns.items())
    ).withColumn("triggered_at", F.lit(datetime(2024, 1, 1)))
    return P.alarm_points(row).collect()


def test_alarm_points(spark):
    rows = alarm(spark, detector="flat_value", mesh_id=MESH, device_id=31, channel="a.b", source="stream", value=6.75, message="m")
    assert {r["field"]: r["value"] if r["field"] == "value" else r["value_str"] for r in rows} == {"message": "m", "value": 6.75}
    assert rows[0]["tags"] == {"detector": "flat_value", "channel": "a.b", "source": "stream"}
    assert (rows[0]["measurement"], rows[0]["node_id"], rows[0]["mesh_id"]) == ("alarms", 31, MESH)


def test_alarm_variants(spark):
    absent = alarm(spark, detector="absence", device_id=1, message="m")
    assert [r["field"] for r in absent] == ["message"] and "channel" not in absent[0]["tags"]
    old = alarm(spark, detector="stuck_value", node_id=31, field="water_level", value=1.0)
    assert old[0]["node_id"] == 31 and old[0]["tags"]["channel"] == "water_level" and old[0]["mesh_id"] is None


def envelopes(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ENVELOPE)


def envelope(gateway="!g1", node=404, port=3, payload="{}", variant=None, decryptable=True, packet=1):
    return (gateway, "LF", node, packet, 1704100800, 1, port, variant, payload, decryptable)


def gated(spark, *rows):
    gateways = spark.createDataFrame([("!g1", "mesh-s"), ("!g2", None)], "gateway_id string, mesh_id string")
    rejections = spark.createDataFrame([("mesh-s", 13)], "mesh_id string, device_id long")
    return K.gate(envelopes(spark, *rows), gateways, rejections)


def test_drop_reasons(spark):
    rows = gated(
        spark,
        envelope(gateway="!unknown", packet=1),
        envelope(gateway=None, packet=2),
        envelope(node=13, decryptable=False, packet=3),
        envelope(decryptable=False, packet=4),
        envelope(port=80, payload=None, packet=5),
        envelope(packet=6),
        envelope(gateway="!g2", node=13, packet=7),
    )
    reasons = {r["packet_id"]: r["drop_reason"] for r in rows.collect()}
    assert reasons == {
        1: K.UNREGISTERED, 2: K.UNREGISTERED, 3: K.REJECTED, 4: K.UNDECRYPTABLE, 5: K.NO_SCHEMA, 6: None, 7: None,
    }
    texts = {r["packet_id"]: r["message"] for r in K.drop_messages(rows).collect()}
    assert "unregistered gateway" in texts[1] and "rejected node mesh-s:13" in texts[3]
    assert "decrypt" in texts[4] and "mesh key" in texts[4] and "portnum 80" in texts[5]
    assert {r[0]: r[1] for r in K.drop_counts(rows).collect()} == {K.UNREGISTERED: 2, K.REJECTED: 1, K.UNDECRYPTABLE: 1, K.NO_SCHEMA: 1}


def test_sightings_and_discoveries(spark):
    events = K.decoded(
        gated(
            spark,
            envelope(payload='{"latitude_i": 87654321, "longitude_i": -1765432109}', packet=1),
            envelope(port=4, payload='{"long_name": "Lock keeper", "short_name": "LK", "hw_model": "MK4"}', packet=2),
            envelope(port=67, variant="device_metrics", payload='{"device_metrics": {"battery_level": 61, "s": "1", "b": true}}', packet=3),
            envelope(gateway="!g2", port=67, variant="device_metrics", payload='{"device_metrics": {"battery_level": 61}}', packet=4),
            envelope(payload='{"latitude_i": 5}', packet=5),
        )
    )
    assert events.count() == 5
    seen = K.sightings(events).collect()
    assert len(seen) == 4 and {r["key"] for r in seen} == {"mesh-s:404"}
    placed = [r for r in seen if r["latitude"] is not None]
    assert [(r["latitude"], r["longitude"]) for r in placed] == [(8.7654321, -176.5432109)]
    named = [r for r in seen if r["name"]]
    assert [(r["name"], r["short_name"], r["hardware_type"], r["role"]) for r in named] == [("Lock keeper", "LK", "MK4", None)]
    found = K.discoveries(events).collect()
    assert [(r["payload_kind"], r["fields"]) for r in found] == [("telemetry:device_metrics", ["battery_level"])]


def test_leaves_and_channels(spark):
    df = spark.createDataFrame(
        [event("telemetry:m", {"time": 5, "top": 1, "m": {"a": 2, "b": True, "in": {"c": 3.5}}, "s": "7"})], schemas.DECODED
    )
    leaves = {(r["field"], r["value"]) for r in K.observations(df).collect()}
    assert leaves == {("time", 5.0), ("top", 1.0), ("a", 2.0), ("c", 3.5)}
    assert ("time", 5.0) not in {(r["field"], r["value"]) for r in K.observations(df, include_time=False).collect()}
    channels = {(r["channel"], r["value"]) for r in K.channels_in(df).collect()}
    assert channels == {("m.top", 1.0), ("m.a", 2.0), ("m.c", 3.5)}


@pytest.mark.parametrize("depth", [1, 4, 5, 6, 12])
def test_objects_of_any_depth_beside_flat_ones(spark, depth):
    nested = {"x": 1.5, "flag": True, "text": "2"}
    for i in range(depth):
        nested = {f"n{i}": nested, f"v{i}": i}
    df = spark.createDataFrame([event("telemetry:m", nested), event("telemetry:m", {"x": 7}, packet=2)], schemas.DECODED)
    found = {(r["packet_id"], r["field"], r["value"]) for r in K.observations(df).collect()}
    assert found == {(1, "x", 1.5), *((1, f"v{i}", float(i)) for i in range(depth)), (2, "x", 7.0)}
    channels = {r["channel"] for r in K.channels_in(df).collect()}
    assert f"n{depth - 1}.x" in channels and f"m.v{depth - 1}" in channels


@pytest.mark.parametrize("depth", [0, 3, 4, 9])
def test_calibration_reaches_any_depth(spark, depth):
    nested = {"x": 2, "y": 3, "s": "2"}
    for i in range(depth):
        nested = {f"n{i}": nested, "x": 1}
    df = spark.createDataFrame([event("telemetry:m", nested), event("telemetry:other", nested, packet=2)], schemas.DECODED)
    changes = spark.createDataFrame(
        [("LF:77:telemetry:m:x", "upsert", "offset_scale", '{"scale": 10, "offset": 1}', 1), ("LF:77:telemetry:m:y", "upsert", "lookup_table", '{"points": [[2, 0], [4, 8]]}', 1)],
        "key string, op string, function_name string, params string, version long",
    )
    found = {r["packet_id"]: json.loads(r["payload"]) for r in calibrate_events(df, changes).collect()}
    assert found[2] == nested
    inner = found[1]
    for i in reversed(range(depth)):
        assert inner["x"] == 11
        inner = inner[f"n{i}"]
    assert inner == {"x": 21, "y": 4, "s": "2"}


def test_a_batch_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "archive")
    flat = K.archive_rows(spark.createDataFrame([event("position", {}, mesh="A", node=1)], schemas.DECODED))
    for moment in ("2024-05-06 07:59:59", "2024-05-06 08:00:05"):
        store.write_archive(flat, path, 1, F.lit(moment).cast("timestamp"))
    assert [r["hour"] for r in spark.read.parquet(path).collect()] == [8]
    points = str(tmp_path / "points")
    both = spark.createDataFrame([event("telemetry:a", {"e": {"x": 1}, "f": {"x": 1}})], schemas.DECODED)
    one = spark.createDataFrame([event("telemetry:a", {"e": {"x": 1}})], schemas.DECODED)
    for events in (both, one):
        store.write_points(P.event_points(events), points, 3)
    assert {r["measurement"] for r in store.read_points(spark, points).collect()} == {"e"}


def test_the_last_copy_to_arrive_stays(spark, tmp_path):
    path = str(tmp_path / "points")
    events = spark.createDataFrame(
        [(*event("telemetry:a", {"a": {"x": 1}}, packet=900), 1), (*event("telemetry:a", {"a": {"x": 2}}, packet=5), 2)], schemas.DECODED + ", arrival long"
    )
    store.write_points(P.event_points(events), path, 1)
    assert [r["value"] for r in store.read_points(spark, path).where("field = 'x'").collect()] == [2.0]


def test_compaction_reads_one_day(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = P.event_points(spark.createDataFrame([event("telemetry:a", {"a": {"x": 1}})], schemas.DECODED))
    later = rows.withColumn("time", F.col("time") + F.expr("interval 3 days"))
    store.write_points(rows.unionByName(later), path, 1)
    compact = str(tmp_path / "compact")
    for day in (datetime(2024, 1, 1), datetime(2024, 1, 4), datetime(2024, 1, 1)):
        store.compact_points(spark, path, compact, day)
    assert store.read_points(spark, compact, deduplicate=False).count() == 6


def test_archive_layout(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame(
        [event("position", {}, mesh="A", node=1), event("position", {}, mesh="A", node=1), event("position", {}, mesh="A", node=2), event("position", {}, node=1)],
        schemas.DECODED,
    )
    flat = K.archive_rows(rows)
    assert tuple(flat.columns) == K.ARCHIVE_COLUMNS
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    store.write_archive(flat, path, 1, at)
    store.write_archive(flat, path, 1, at)  # a replay of the batch
    assert spark.read.parquet(path).count() == 4
    folders = {str(p.parent.relative_to(path)) for p in (tmp_path / "archive").rglob("*.parquet")}
    assert "ingest_batch=1/mesh_id=A/node_id=1/dt=2024-05-06/hour=07" in folders
    assert len(folders) == 3
    store.write_archive(flat.limit(0), path, 2, at)
    assert spark.read.parquet(path).count() == 4


def test_archive_is_written_without_a_process_a_folder(spark, tmp_path, monkeypatch):
    """On a mounted file system no checksum file is made beside a file, as the engine's committer does, and its folders
    and rows are those the engine writes; a run that fails leaves the batch that was there."""
    meshes = ["A", "", None, "a/b=%c d", "x:{[\t]}", "\u00e9"]
    events = [event("position", {"n": i}, mesh=meshes[i % 6], node=i % 11 or None, packet=i) for i in range(300)]
    flat = K.archive_rows(spark.createDataFrame(events, schemas.DECODED)).repartition(3)
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    path, plain = tmp_path / "archive", tmp_path / "plain"
    store.write_archive(flat, str(path), 1, at)
    with monkeypatch.context() as patched:
        patched.setattr(store.folders, "mounted", lambda *_: None)
        store.write_archive(flat, str(plain), 1, at)
    folders = lambda root: sorted({str(p.parent.relative_to(root)) for p in root.rglob("*.parquet")})
    rows = lambda root: sorted(map(str, spark.read.parquet(str(root)).collect()))
    assert folders(path) == folders(plain) and len(folders(path)) == 55
    assert rows(path) == rows(plain) and len(rows(path)) == 300
    read = lambda root: sorted(map(str, store.read_archive(spark, str(root)).collect()))
    assert read(path) == read(plain) and len(read(path)) == 300
    assert spark.read.parquet(str(path)).schema == spark.read.parquet(str(plain)).schema
    assert list(plain.rglob("*.crc")) and not list(path.rglob("*.crc"))
    bad = flat.withColumn("payload_json", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.write_archive(bad, str(path), 1, at)
    assert len(rows(path)) == 300
    assert [p.name for p in path.iterdir()] == ["ingest_batch=1"]


def test_archive_is_read_as_it_was_written(spark, tmp_path):
    """Names of folders are not guessed at: a mesh `007` is no number."""
    flat = K.archive_rows(spark.createDataFrame([event("position", {"n": 1}, mesh="007", node=3), event("position", {}, mesh=None, node=None)], schemas.DECODED))
    store.write_archive(flat, str(tmp_path), 4, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    read = store.read_archive(spark, str(tmp_path))
    assert sorted(map(str, read.select(*flat.columns).collect())) == sorted(map(str, flat.collect()))
    assert [tuple(r) for r in read.select("mesh_id", F.col("dt").cast("string"), "hour", "ingest_batch").orderBy("mesh_id").collect()] == [
        (None, "2024-05-06", 7, 4), ("007", "2024-05-06", 7, 4)
    ]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and store.read_archive(spark, str(tmp_path), ("packet_id",)).count() == 2


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    path, group = str(tmp_path / "archive"), "listing"
    for node in range(100):
        (tmp_path / f"archive/ingest_batch=1/mesh_id=A/node_id={node}/dt=2024-05-06/hour=07").mkdir(parents=True)
    flat = K.archive_rows(spark.createDataFrame([event("position", {}, mesh="A", node=1)], schemas.DECODED))
    store.write_archive(flat, path, 2, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        assert spark.read.parquet(path).count() == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 64


def test_points_store_keeps_the_last_write(spark, tmp_path):
    path, compact = str(tmp_path / "points"), str(tmp_path / "compact")
    first = P.event_points(spark.createDataFrame([event("telemetry:a", {"a": {"x": 1}})], schemas.DECODED))
    second = P.event_points(spark.createDataFrame([event("telemetry:a", {"a": {"x": 2}})], schemas.DECODED))
    store.write_points(first, path, 1)
    store.write_points(second, path, 2)
    day = datetime(2024, 1, 1)
    rows = store.read_points(spark, path, day, datetime(2024, 1, 2), ["a"])
    assert [r["value"] for r in rows.where("field = 'x'").collect()] == [2.0]
    assert rows.count() == 3
    store.compact_points(spark, path, compact, day)
    assert store.read_points(spark, compact, deduplicate=False).count() == 3
    assert store.read_channel(rows, "a.x").count() == 1
    with pytest.raises(ValueError):
        store.read_channel(rows, "nodot")


def test_json_feed(spark):
    lines = ['{"node_id": 1}', "null", None, "{", "[1]", '"text"', '{"node_id": "x"}']
    parsed = feeds.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"), schemas.DECODED)
    assert [r["node_id"] for r in feeds.accepted(parsed).collect()] == [1]
    assert sorted(r["reject_reason"] for r in feeds.dead_letters(parsed).collect()) == ["not_an_object", "not_an_object", "not_json", "wrong_type"]


def test_units(spark):
    units = ["degC", "g/m3", "s", "%", "ratio", "count", "ppb", "ug/m3", "1/100", "furlong", "", None]
    df = spark.createDataFrame([(u,) for u in units], "u string")
    kinds = {r[0]: r[1] for r in df.select("u", quantity_kind(F.col("u"))).collect()}
    assert kinds == {
        "degC": "physical_property", "g/m3": "physical_property", "s": "physical_property", "%": "ratio", "ratio": "ratio",
        "count": "count", "ppb": "concentration", "ug/m3": "concentration", "1/100": "other", "furlong": None, "": None, None: None,
    }
    known = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in QUALITY_FIELD_UNITS.values()], "u string").select("u", quantity_kind(F.col("u"))).collect()}
    assert all(known.values())
