"""Payloads of any depth: the same leaves and the same text at 3, 5 and 600 levels."""

import json

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.deep import number_text, text_of
from sensorloom.operators import packets
from sensorloom.operators.calibrate import calibrate_events

VALUES = [40_000_000.0, 1e-7, 0.001, 0.00099, 9_999_999.0, 1e7, -2.5e-5, 123.25, 3, 0.5, 1e22, -0.0, 12_345_678.9]


def nested(depth, inner):
    text = inner
    for i in range(depth - 1):
        text = '{"l%d":%s}' % (i, text)
    return text


@pytest.mark.parametrize("depth", [1, 3, 4, 5, 600])
def test_calibrated_alike_at_any_depth(spark, depth):
    inner = json.dumps({f"v{i}": 1 for i in range(len(VALUES))} | {"text": "é\"x", "flag": True, "none": None, "list": [1, {"v0": 1}, []], "no": {}}, separators=(",", ":"), ensure_ascii=False)
    rows = [(1, 1, 67, 0, 1, "LF", "!g", "m", "telemetry:e", nested(depth, inner))]
    changes = [(f"LF:1:telemetry:e:v{i}", None, "offset_scale", json.dumps({"scale": 0, "offset": v}), i) for i, v in enumerate(VALUES)]
    events = spark.createDataFrame(rows, schemas.DECODED)
    [row] = calibrate_events(events, spark.createDataFrame(changes, schemas.CALIBRATION_CHANGE)).collect()
    flat = rows[0][:-1] + (inner,)
    [plain] = calibrate_events(spark.createDataFrame([flat], schemas.DECODED), spark.createDataFrame(changes, schemas.CALIBRATION_CHANGE)).collect()
    # Members of a variant are in the order of their names, so texts are compared with theirs in order.
    order = lambda text: json.dumps(json.loads(text, parse_float=lambda x: f"float {x}"), sort_keys=True)
    assert order(row.payload) == order(nested(depth, plain.payload))
    leaves = {r.field: r.value for r in packets.observations(events).collect()}
    assert leaves == {f"v{i}": 1.0 for i in range(len(VALUES))}


def test_numbers_are_written_as_the_engine_does(spark):
    frame = spark.createDataFrame([(float(v),) for v in VALUES], "v double")
    assert [number_text(float(v)) for v in VALUES] == [r[0] for r in frame.select(F.to_json(F.struct("v"))).select(F.expr("substring(`to_json(struct(v))`, 6, length(`to_json(struct(v))`) - 6)")).collect()]


def test_text_without_recursion():
    value = {"a": [1, [], {}, {"b": [None, True, "x\n"]}], "c": {"d": {}}}
    assert text_of(value) == json.dumps(value, separators=(",", ":"))
    deep = {}
    for _ in range(100_000):
        deep = {"a": deep}
    assert len(text_of(deep)) == 600_002
