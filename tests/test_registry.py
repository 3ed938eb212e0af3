from datetime import datetime, timezone

from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators import changelog as L, quality as Q, registry as R
from sensorloom.plans import notify

T1, T2, T3 = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3))


def device(id, device_id, mesh, **more):
    names = [c.split()[0] for c in schemas.DEVICE.split(", ")]
    row = dict.fromkeys(names)
    row.update(id=id, device_id=device_id, mesh_id=mesh, is_gateway=False, is_allowed=True, location_overridden=False, nodeinfo_overridden=False)
    row.update(more)
    return tuple(row[n] for n in names)


def sighting(mesh, device_id, seen, **more):
    row = dict.fromkeys(["latitude", "longitude", "name", "short_name", "hardware_type", "role"])
    row.update(more)
    return (f"{mesh}:{device_id}", mesh, device_id, *row.values(), seen, more.get("op", "upsert"))


def test_device_upsert(spark):
    devices = spark.createDataFrame(
        [
            device("a", 1, "m1", name="old", role="r"),
            device("b", 2, "m1", name="pinned", nodeinfo_overridden=True, location_overridden=True, latitude=1.0, longitude=2.0),
            device("c", 3, "m2", is_allowed=False),
            device("d", 4, "m2"),
        ],
        schemas.DEVICE,
    )
    sightings = spark.createDataFrame(
        [
            sighting("m1", 1, T1, name="first"),
            sighting("m1", 1, T2, name="second", latitude=5.0, longitude=6.0),
            sighting("m1", 1, T3),
            sighting("m1", 2, T1, name="new", latitude=9.0, longitude=9.0),
            sighting("m1", 3, T2),  # 3 is registered elsewhere, but not allowed there
            sighting("m1", 4, T1),  # 4 is allowed in m2: clash
            sighting("m2", 5, T2),
            sighting("m1", 5, T1),  # 5 is new in two meshes: the first sighted wins
            sighting("nowhere", 6, T1),
        ],
        schemas.SIGHTING,
    )
    meshes = spark.createDataFrame([("m1",), ("m2",)], "mesh_id string")
    rows = {(r["mesh_id"], r["device_id"]): r for r in R.upsert_devices(devices, sightings, meshes).collect()}
    assert set(rows) == {("m1", 1), ("m1", 2), ("m2", 3), ("m2", 4), ("m1", 3), ("m1", 5)}
    one = rows[("m1", 1)]
    assert (one["name"], one["role"], one["latitude"], one["id"]) == ("second", "r", 5.0, "a")
    assert one["last_seen"].day == 3
    two = rows[("m1", 2)]
    assert (two["name"], two["latitude"]) == ("pinned", 1.0) and two["last_seen"].day == 1
    new = rows[("m1", 5)]
    assert new["is_allowed"] and not new["is_gateway"] and new["id"] == "m1:5"
    assert rows[("m2", 4)]["last_seen"] is None


def test_changelog(spark):
    changes = spark.createDataFrame(
        [("a", "upsert", 1, 1), ("a", "delete", 2, 2), ("b", None, 3, 1), ("b", "upsert", 4, 3), ("c", "delete", 5, 1), ("c", "upsert", 6, 2), (None, "upsert", 7, 9), ("", "upsert", 8, 9)],
        "key string, op string, v int, version int",
    )
    assert {(r["key"], r["v"]) for r in L.latest_per_key(changes).collect()} == {("b", 4), ("c", 6)}


def test_measurement_types_keep_their_unit(spark):
    current = spark.createDataFrame(
        [("k", "a", "V", None), ("k", "b", None, "other"), ("k", "z", None, None)],
        "payload_kind string, field_name string, native_unit string, quantity_kind string",
    )
    found = spark.createDataFrame(
        [
            ("m", 1, "k", ["a", "b", "c"], {"a": "mm", "b": "%", "c": "ppb"}, T1, "upsert"),
            ("m", 1, "k", ["c", "d"], {"c": "V"}, T2, "upsert"),
            ("m", 9, "k", ["e"], None, T1, "upsert"),
        ],
        schemas.DISCOVERY,
    )
    devices = spark.createDataFrame([device("a", 1, "m")], schemas.DEVICE)
    rows = {r["field_name"]: (r["native_unit"], r["quantity_kind"]) for r in R.upsert_measurement_types(current, found, devices).collect()}
    assert rows == {"a": ("V", None), "b": ("%", "other"), "c": ("ppb", "concentration"), "d": (None, None), "z": (None, None)}
    seen = R.upsert_measurements(None, found, devices)
    assert {(r["field_name"], r["first_seen"].day, r["last_seen"].day) for r in seen.collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 1, 2), ("d", 2, 2)}
    again = R.upsert_measurements(seen, found.where("seen_at = timestamp '2024-01-02'"), devices)
    assert {(r["field_name"], r["first_seen"].day) for r in again.collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 2)}


def test_masking_and_ownership(spark):
    meshes = spark.createDataFrame([("m1", "o1", "k1"), ("m2", "o2", "k2")], "mesh_id string, owner_id string, mesh_key string")
    assert [r["mesh_key"] for r in R.masked(meshes, ["mesh_key"], "o1").orderBy("mesh_id").collect()] == ["k1", None]
    assert [r["mesh_key"] for r in R.masked(meshes, ["mesh_key"], None).collect()] == [None, None]
    devices = spark.createDataFrame([device("a", 1, "m1"), device("b", 1, "m2")], schemas.DEVICE)
    rows = spark.createDataFrame([("m1", 1, 5), ("m2", 1, 6)], "mesh_id string, node_id long, v int")
    assert [r["v"] for r in R.owned_by(rows, devices, meshes, "o2").collect()] == [6]
    assert R.owned_by(rows, devices, meshes, None).count() == 2


def test_catalog_filter(spark):
    types = spark.createDataFrame(
        [("telemetry:a", "x"), ("telemetry:a", "y"), ("telemetryx", "x"), ("quality", "x")], "payload_kind string, field_name string"
    )
    assert R.filter_types(types, kind="telemetry").count() == 2
    assert R.filter_types(types, kind="quality").count() == 1
    assert R.filter_types(types, payload_kind="telemetry:a", field_name="y").count() == 1


def test_completeness_edges(spark):
    channels = spark.createDataFrame(
        [("m", 1, "a.x", 600), ("m", 2, "a.x", 600), ("m", 3, "a.x", None), ("m", 4, "a.x", 0), ("m", 5, "a.x", 10**6)],
        "mesh_id string, node_id long, channel string, interval_seconds int",
    )
    base = int(T1.timestamp())
    moments = [("m", 1, base + s) for s in (0, 600, 1200, 3100, 3600)] + [("m", 5, base)]
    readings = spark.createDataFrame(moments, "mesh_id string, node_id long, s long").select(
        "mesh_id", "node_id", F.lit("a.x").alias("channel"), F.timestamp_seconds("s").alias("time")
    )
    stats = Q.completeness(channels, readings, 3600)
    rows = {r["node_id"]: (r["observed"], r["expected"], round(r["completeness_ratio"], 3), r["largest_gap_seconds"]) for r in stats.collect()}
    assert rows == {1: (5, 6, 0.833, 1900.0), 2: (0, 6, 0.0, 0.0), 5: (1, 1, 1.0, 0.0)}
    alarms = {r["device_id"]: (r["value"], r["message"]) for r in Q.completeness_alarms(stats, "-1h", T1).collect()}
    assert set(alarms) == {1, 2}
    assert alarms[1][0] == 1900.0 and "1900s hole, over 3x the 600s" in alarms[1][1]
    assert alarms[2][0] == 0.0 and "Only 0 of ~6 expected readings in -1h (0%)" in alarms[2][1]


def test_notifications_route_before_they_cool_down(spark):
    devices = spark.createDataFrame([device("a", 1, "m1"), device("b", 2, "m2", label="L")], schemas.DEVICE)
    meshes = spark.createDataFrame([("m1", "o1", None, "ch1"), ("m2", "o2", "Lab", "ch2")], "mesh_id string, owner_id string, label string, channel_id string")
    owners = spark.createDataFrame([("o1", "N", "a@b", False), ("o2", "O", "c@d", True)], "owner_id string, name string, email string, is_active boolean")
    rows = [(m, d, None, det, "batch", 1.0, "x", datetime.fromtimestamp(T1.timestamp() + s, timezone.utc)) for m, d, det, s in [
        ("m1", 1, "absence", 0), ("m2", 2, "absence", 0), ("m2", 2, "absence", 3599), ("m2", 2, "absence", 3600), ("m2", 2, "other", 10), ("m2", 7, "absence", 0), (None, 2, "absence", 0)]]
    alarms = spark.createDataFrame(rows, schemas.ALARM)
    sent = notify.notifications(alarms, devices, meshes, owners).collect()
    got = sorted((r["detector"], int(r["triggered_at"].replace(tzinfo=timezone.utc).timestamp() - T1.timestamp()), r["subject"], r["device_label"], r["mesh_label"]) for r in sent)
    assert got == [
        ("absence", 0, "Device has stopped publishing", "L", "Lab"),
        ("absence", 3600, "Device has stopped publishing", "L", "Lab"),
        ("other", 10, "Data quality alarm", "L", "Lab"),
    ]
