"""Blueprints as data give what blueprints as columns give, at any number of them."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators import blueprints as B, recipes as R
from sensorloom.plans import fleet_scan, quality_scan
from sensorloom.sources import store

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
DEVICE = "mesh_id string, device_id long, postprocessing_blueprint_id string, reading_interval_seconds int"
READING = "mesh_id string, node_id long, channel string, measurement string, field string, value double, value_type string, time timestamp, packet_id long"
FUNCTIONS = {
    "linear": ("value",), "ratio": ("numerator", "denominator"), "difference": ("minuend", "subtrahend"), "dew_point": ("temperature", "humidity"),
    "ppb_to_ugm3": ("ppb", "temperature"), "unheard_of": ("value",),
}
OUTPUT = {"linear": "value", "ratio": "ratio", "difference": "difference", "dew_point": "dew_point", "ppb_to_ugm3": "mass", "unheard_of": "x"}


def recipe(r):
    channels = ["a.x", "b.x", "c.y"]
    steps = []
    for order in range(1, r.randint(2, 7)):
        name = r.choice(list(FUNCTIONS))
        inputs = {arg: r.choice(channels + ["late", "no.one"] * (r.random() < 0.1)) for arg in FUNCTIONS[name]}
        params = {"linear": {"scale": r.choice((2, -0.5, "3", "bad")), "offset": 1}, "ppb_to_ugm3": r.choice(({"molar_mass_g": 48}, {}))}.get(name, {})
        out = r.choice(("p", "q", "r", "late"))
        outputs = {OUTPUT[name]: out} | ({"other": "never"} if r.random() < 0.2 else {})
        steps.append(B.Step(order, name, inputs, params, outputs))
        channels.append(out)
    return steps


def readings(r, nodes):
    rows = []
    for node in range(nodes):
        for channel in ("a.x", "b.x", "c.y"):
            for _ in range(r.randint(0, 12)):
                at = NOON + timedelta(seconds=r.choice((-1, 1)) * r.randint(0, 90_000))
                value = r.choice((0.0, None, float(r.randint(-20, 60))))
                rows.append(("m", node, channel, *channel.split("."), value, "double", at, len(rows)))
    return rows


def tables(spark, recipes, nodes, seed):
    r = random.Random(seed)
    rows = [(name, s.order, s.function_name, s.inputs, json.dumps(s.params), s.outputs) for name, steps in recipes.items() for s in steps]
    names = [*recipes, None]
    devices = [("m", n, names[n % len(names)], r.choice((None, 0, 30_000, 200_000))) for n in range(nodes)]
    return spark.createDataFrame(rows, schemas.BLUEPRINT_STEP), spark.createDataFrame(devices, DEVICE), spark.createDataFrame(readings(r, nodes), READING)


@pytest.mark.parametrize("seed", range(2))
def test_as_columns_or_as_data(spark, seed):
    recipes = {f"bp{i}": recipe(random.Random(seed * 100 + i)) for i in range(6)}
    recipes = {k: v for k, v in recipes.items() if B.required_channels(v)}
    steps, devices, points = tables(spark, recipes, 25, seed)
    columns = ["node_id", "blueprint_id", "step_order", "written_by", "field", "time", "value"]
    want, failed, units = [], {}, {}
    for name, own in recipes.items():
        run = B.run_steps(own, B.align_for(own, points, devices.where(F.col("postprocessing_blueprint_id") == name)), {"a.x": "V", "b.x": "degC"})
        want += [tuple(x) for x in B.derived_rows(run, name).select(*columns).collect()]
        units[name] = {c: u for c, u in run.units.items() if u} or None
        for f in B.failure_counts(run).collect():
            failed[f[0]] = failed.get(f[0], 0) + f[1]
    types = spark.createDataFrame([("telemetry:a", "x", "V"), ("telemetry:b", "x", "degC")], "payload_kind string, field_name string, native_unit string")
    run = quality_scan.run_blueprints(steps, devices, points, types, NOON + timedelta(days=9), "-30d")
    got = [tuple(x) for x in run.derived.select(*columns).collect()]
    close = lambda rows: sorted((*x[:6], round(x[6], 9)) for x in rows)
    assert close(got) == close(want) and got
    assert {x[0]: x[1] for x in run.failures.collect()} == failed
    found = {x.blueprint_id: x.field_units for x in R.unit_table(run.bound).collect()}
    assert found == {k: units[k] for k in found}


def test_plan_does_not_grow_with_blueprints(spark, tmp_path):
    sizes = []
    for n in (2, 300):
        recipes = {f"bp{i}": [B.Step(1, "linear", {"value": "a.x"}, {"scale": i}, {"value": "p"}), B.Step(2, "ratio", {"numerator": "p", "denominator": "b.x"}, {}, {"ratio": "q"})] for i in range(n)}
        steps, devices, points = tables(spark, recipes, n, 5)
        path = str(tmp_path / f"points-{n}")
        points.write.parquet(path)
        run = quality_scan.run_blueprints(steps, devices, spark.read.schema(READING).parquet(path), None, NOON + timedelta(days=9), "-30d")
        plan = run.derived._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
        sizes.append(len(plan.splitlines()))
    assert sizes[0] == sizes[1]


def test_many_blueprints_are_not_broadcast(spark, tmp_path):
    """Beyond a few steps no table of blueprints or devices is sent to the driver; only the catalog's channels are."""
    n, path = 6_000, str(tmp_path)
    step = "struct({} AS `order`, '{}' AS function_name, {} AS inputs, {} AS params, {} AS outputs)".format
    first = step(1, "linear", "map('value', 'a.x')", "concat('{\"scale\": ', id, '}')", "map('value', 'p')")
    second = step(2, "difference", "map('minuend', 'p', 'subtrahend', 'b.x')", "'{}'", "map('difference', 'q')")
    ids = spark.range(n)
    ids.selectExpr("concat('bp', id) AS blueprint_id", f"inline(array({first}, {second}))").write.parquet(f"{path}/steps")
    ids.selectExpr("'m' AS mesh_id", "id AS device_id", "concat('bp', id) AS postprocessing_blueprint_id", "10 AS reading_interval_seconds").write.parquet(f"{path}/devices")
    rows = [("m", node, c, *c.split("."), v, "double", NOON, i) for node in (0, 7, n - 1) for i, (c, v) in enumerate((("a.x", 2.0), ("b.x", 1.0)))]
    spark.createDataFrame(rows, READING).write.parquet(f"{path}/points")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    types = spark.createDataFrame([("telemetry:a", "x", "V")], "payload_kind string, field_name string, native_unit string")
    run = quality_scan.run_blueprints(read("steps"), read("devices"), read("points"), types, NOON + timedelta(days=1), "-30d")
    for rows in (run.derived, run.bound):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= plan.count("MapInPandas") and "BroadcastNestedLoopJoin" not in plan
    got = sorted((r.node_id, r.blueprint_id, r.field, r.value) for r in run.derived.collect())
    assert got == [x for node in (0, 7, n - 1) for x in ((node, f"bp{node}", "p", 2.0 * node), (node, f"bp{node}", "q", 2.0 * node - 1))]
    assert R.joined_by(read("steps").limit(100)) == ()


def test_needed_channels(spark):
    """A row a blueprint with what the table of required channels has, for steps without inputs or outputs too."""
    rows = [
        ("one", 1, "linear", {"value": "b.x"}, None, {"value": "p"}), ("one", 1, "ratio", {"numerator": "p", "denominator": "a.x"}, None, {"ratio": "q"}),
        ("one", 2, "linear", {"value": "b.x"}, None, None), ("own", 1, "linear", {"value": "p"}, None, {"value": "p"}),
        ("null", 1, "linear", None, None, None), ("null", 2, "linear", {"value": None}, None, {"value": None}), ("half", 1, "linear", {"value": None, "x": "c"}, None, {}),
    ]
    steps = spark.createDataFrame(rows, schemas.BLUEPRINT_STEP)
    want = {}
    for r in B.required_channels_table(steps).where("channel is not null").collect():
        want.setdefault(r.blueprint_id, []).append(r.channel)
    assert {r.blueprint_id: r.channels for r in R.needed_channels(steps).collect()} == {k: sorted(v) for k, v in want.items()} == {"one": ["a.x", "b.x"], "half": ["c"]}


def test_steps_run_once_a_row(spark, tmp_path):
    """The plan holds the fold of the steps once, and in it each function once."""
    recipes = {"bp": [B.Step(1, "ppb_to_ugm3", {"ppb": "a.x", "temperature": "b.x"}, {"molar_mass_g": 48}, {"mass": "p"})]}
    steps, devices, points = tables(spark, recipes, 4, 5)
    path = str(tmp_path / "points")
    points.write.parquet(path)
    run = quality_scan.run_blueprints(steps, devices, spark.read.schema(READING).parquet(path), None, NOON + timedelta(days=9), "-30d")
    for rows in (run.derived, run.failures):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(filter(recipe") == 1
        assert plan.count("function_name = ppb_to_ugm3") == 1


def test_scan_folds_copies_before_they_are_points(spark, tmp_path, monkeypatch):
    """A channel that is listed twice gives each of its figures once, and the store need not fold the points again."""
    seen, write = [], store.write_points
    monkeypatch.setattr(store, "write_points", lambda rows, path, batch, settled=False: (seen.append(settled), write(rows, path, batch, settled)))
    recipes = {"bp": [B.Step(i, "linear", {"value": "a.x"}, {"scale": i}, {"value": "p"}) for i in (1, 2)]}
    steps, devices, _ = tables(spark, recipes, 4, 5)
    rows = [("m", 0, "a.x", "a", "x", float(v), "double", NOON + timedelta(hours=v), v) for v in (1, 2)]
    rows.append(("m", 0, "a.x", "a", "x", 7.0, "double", NOON + timedelta(hours=2), 3))
    channels = spark.createDataFrame([("m", 0, "telemetry:a", "a.x", "measured")] * 2, "mesh_id string, device_id long, payload_kind string, channel string, origin string")
    variants = spark.createDataFrame([("telemetry:a", 3_600)], "payload_kind string, default_reading_interval_seconds int")
    paths = fleet_scan.scan_fleet(
        spark.createDataFrame(rows, READING), channels, devices, variants, steps, None, str(tmp_path), 1, NOON + timedelta(days=1), "-30d", "-30d"
    )
    assert seen == [True]
    got = [(r.measurement, r.field, r.time.replace(tzinfo=timezone.utc)) for r in store.read_points(spark, paths.points, deduplicate=False).collect()]
    figures = ("completeness_ratio", "expected", "largest_gap_seconds", "observed")
    want = [("derived", "p", NOON + timedelta(hours=v)) for v in (1, 2)] + [("quality", f, NOON + timedelta(days=1)) for f in figures]
    assert sorted(got) == want


def test_blueprints_are_bound_in_batches(spark):
    """A call of Python binds a batch of blueprints, not one; steps without inputs, outputs or a known function too."""
    rows = [(f"bp{i}", o, n, x, p, y) for i in range(300) for o, n, x, p, y in (
        (2, "ratio", {"numerator": "p", "denominator": "b.x"}, None, {"ratio": "q"}), (1, "linear", {"value": "a.x"}, json.dumps({"scale": i}), {"value": "p"}),
        (3, "unheard_of", None, None, None), (4, None, None, None, None))]
    bound = R.bound_steps(spark.createDataFrame(rows, schemas.BLUEPRINT_STEP))
    assert "FlatMapGroups" not in bound._jdf.queryExecution().executedPlan().toString()
    got = {(r.blueprint_id, r.order): (r.function_name, json.loads(r.inputs), json.loads(r.params), json.loads(r.outputs), r.stage) for r in bound.collect()}
    want = {(f"bp{i}", 1): ("linear", {"value": "a.x"}, {"scale": i}, {"value": "p"}, 0) for i in range(300)}
    assert got == want | {(f"bp{i}", 2): ("ratio", {"numerator": "p", "denominator": "b.x"}, {}, {"ratio": "q"}, 0) for i in range(300)}


def test_stages_of_windowed_steps(spark):
    """A chain of windowed steps, one that overwrites what an earlier one reads, and rows without an input."""
    own = [
        B.Step(1, "rolling_mean", {"value": "a.x"}, {"seconds": 100}, {"mean": "m"}),
        B.Step(2, "linear", {"value": "m"}, {"offset": 1}, {"value": "m1"}),
        B.Step(3, "exponential_smoothing", {"value": "m1"}, {"alpha": 0.5}, {"smoothed": "s"}),
        B.Step(4, "linear", {"value": "a.x"}, {"scale": 10}, {"value": "m"}),
        B.Step(5, "rate_of_change", {"value": "m"}, {}, {"rate": "m"}),
        B.Step(6, "ratio", {"numerator": "s", "denominator": "b.x"}, {}, {"ratio": "q"}),
        B.Step(7, "rolling_mean", {"value": "q"}, {}, {"mean": "fails"}),
    ]
    at = [NOON + timedelta(seconds=60 * i) for i in range(4)]
    a, b = [1.0, 3.0, 5.0, 4.0], [2.0, 0.0, 2.0, 1.0]
    rows = [("m", 0, c, *c.split("."), v, "double", t, i) for c, values in (("a.x", a), ("b.x", b)) for i, (t, v) in enumerate(zip(at, values))]
    steps = spark.createDataFrame([("bp", s.order, s.function_name, s.inputs, json.dumps(s.params), s.outputs) for s in own], schemas.BLUEPRINT_STEP)
    devices = spark.createDataFrame([("m", 0, "bp", 10)], DEVICE)
    run = quality_scan.run_blueprints(steps, devices, spark.createDataFrame(rows, READING), None, at[-1], "-1d")
    got = {(x.written_by, (x.time.replace(tzinfo=timezone.utc) - NOON).seconds // 60): round(x.value, 9) for x in run.derived.collect()}
    mean = [1.0, 2.0, 4.0, 4.5]
    smooth = [2.0]
    for x in mean[1:]:
        smooth.append((x + 1 + smooth[-1]) / 2)
    want = {(1, i): x for i, x in enumerate(mean)} | {(2, i): x + 1 for i, x in enumerate(mean)} | {(3, i): x for i, x in enumerate(smooth)}
    want |= {(4, i): 10 * x for i, x in enumerate(a)} | {(5, i): round(10 * (a[i] - a[i - 1]) / 60, 9) for i in (1, 2, 3)}
    want |= {(6, i): round(smooth[i] / b[i], 9) for i in (0, 2, 3)}
    assert got == want
    assert {x[0]: x[1] for x in run.failures.collect()} == {"ratio": 1, "rate_of_change": 1, "rolling_mean": 3}
    assert {x.field: x.step_order for x in run.derived.collect()}["m"] == 5
