"""Calibration, alignment and blueprints."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import calibration as C
from ..operators import align, blueprints as B, changelog as L, recipes as R
from ..operators.calibrate import calibrate_events
from ..operators.series import in_range
from ..functions.bounds import resolve_bound
from ..plans import fleet_scan, quality_scan
from ..session import shared_folder
from ..sources import store
from . import health
from .registry import query
from .tables import AS_OF, AS_OF_SQL, stamp, with_views

DAY2 = 172_800

# --- calibration -----------------------------------------------------------

_VIEWED = "payload_kind = 'telemetry:view' AND channel_id = 'primary' AND o_orderkey IS NOT NULL"


@query(
    "j03_c05_calibrated_events",
    with_views(
        f"""SELECT packet_id, payload_kind, CAST(json_extract(payload, '$.uptime') AS BIGINT) AS uptime,
             json_extract_string(payload, '$.view.seq') AS seq,
             round(CASE WHEN {_VIEWED} AND o_orderkey % 4 = 0 THEN v * 2 - 1
                  WHEN {_VIEWED} AND o_orderkey % 4 = 1 THEN
                    CASE WHEN v <= 0 THEN 5 WHEN v >= 200 THEN 190 WHEN v <= 50 THEN 5 + v / 50 * 55 ELSE 60 + (v - 50) / 150 * 130 END
                  ELSE v END, 6) AS value
        FROM (SELECT *, CAST(json_extract(payload, '$.view.value') AS DOUBLE) AS v FROM dec) LEFT JOIN cfg ON o_custkey = node_id""",
        "dec",
        "cfg",
    ),
)
def calibrated_events(t):
    payload = F.col("payload")
    return calibrate_events(t.decoded(), t.calibration_changes()).select(
        "packet_id",
        "payload_kind",
        F.get_json_object(payload, "$.uptime").cast("bigint").alias("uptime"),
        F.get_json_object(payload, "$.view.seq").alias("seq"),
        F.get_json_object(payload, "$.view.value").cast("double").alias("value"),
    )


@query(
    "c01_c04_curves",
    """SELECT event_id, round(CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value * 0.5 + 3 WHEN 'error' THEN value * 4
           WHEN 'purchase' THEN CASE WHEN value <= 10 THEN 1 WHEN value >= 300 THEN 120 WHEN value <= 50 THEN 3 + (value - 10) / 40 * 17
                                     ELSE 30 + (value - 50) / 250 * 70 END
           ELSE 7 END, 6) AS value FROM events""",
)
def curves(t):
    """Every reading through the curve of its kind: identity, scale and
    offset, scale alone, a table with doubled ends, a single-point table."""
    table = '{"points": [[50, 30], [10, 3], [10, 1], [50, 20], [300, 120], [300, 100]]}'
    kind = F.col("event_type")
    rows = t.events().withColumn(
        "function_name",
        F.when(kind == "click", "identity").when(kind.isin("view", "error"), "offset_scale").otherwise("lookup_table"),
    ).withColumn(
        "params",
        F.when(kind == "view", '{"scale": 0.5, "offset": 3}')
        .when(kind == "error", '{"scale": 4}')
        .when(kind == "purchase", table)
        .otherwise('{"points": [[5, 7]]}'),
    )
    curve = C.parse_params(rows)
    return curve.select("event_id", C.apply_curve(F.col("value"), F.col("curve")).alias("value"))


# --- alignment -------------------------------------------------------------


def _nearest(name: str, channel: str) -> str:
    return f"""SELECT b.mesh_id, b.node_id, b.time, arg_min(o.value, (abs(epoch_us(o.time) - epoch_us(b.time)), -epoch_us(o.time))) AS {name}
        FROM base b JOIN span o ON o.mesh_id = b.mesh_id AND o.node_id = b.node_id AND o.channel = '{channel}'
        AND o.time BETWEEN b.time - to_microseconds(b.reach) AND b.time + to_microseconds(b.reach) GROUP BY b.mesh_id, b.node_id, b.time"""


_ALIGN = {
    "span": "SELECT v.*, CAST(86400000000 AS BIGINT) AS reach FROM vals v",
    "base": "SELECT * FROM span WHERE channel = 'click.value'",
    "p": _nearest("p", "purchase.value"),
    "w": _nearest("w", "view.value"),
    "aligned": """SELECT mesh_id, node_id, base.time, base.value AS c, p, w
        FROM base JOIN p USING (mesh_id, node_id, time) JOIN w USING (mesh_id, node_id, time)""",
}


@query(
    "j05_w04_align",
    with_views(
        f"SELECT mesh_id, node_id, {stamp('time')} AS time, round(c, 6) AS click, round(p, 6) AS purchase, round(w, 6) AS view FROM aligned",
        "vals",
        **_ALIGN,
    ),
)
def aligned(t):
    rows = align.align_nearest(
        t.points(("value",)), ["view.value", "purchase.value", "click.value"], interval=DAY2, tie=("packet_id",)
    )
    return rows.select(
        "mesh_id", "node_id", "time", *[F.col(f"`{c}.value`").alias(c) for c in ("click", "purchase", "view")]
    )


@query(
    "j05_align_pair",
    with_views(
        f"""SELECT mesh_id, node_id, {stamp('time')} AS time, round(base.value, 6) AS error, round(s, 6) AS signup
        FROM base JOIN s USING (mesh_id, node_id, time)""",
        "vals",
        span="SELECT v.*, CAST(10800000000 AS BIGINT) AS reach FROM vals v",
        base="SELECT * FROM span WHERE channel = 'error.value'",
        s=_nearest("s", "signup.value"),
    ),
)
def aligned_pair(t):
    rows = align.align_nearest(
        t.points(("value",)), ["error.value", "signup.value"], interval=21_600, tie=("packet_id",)
    )
    return rows.select("mesh_id", "node_id", "time", F.col("`error.value`").alias("error"), F.col("`signup.value`").alias("signup"))


# --- blueprints ------------------------------------------------------------

# The two recipes of the fleet: (order, function, inputs, params, outputs).
RECIPES = {
    "bp-1": [
        (1, "linear", {"value": "click.value"}, {"scale": 0.5, "offset": 1}, {"value": "half_click"}),
        (2, "ratio", {"numerator": "half_click", "denominator": "view.value"}, {}, {"ratio": "click_ratio"}),
        (3, "unheard_of", {"value": "view.value"}, {}, {"value": "nothing"}),
        (4, "dew_point", {"temperature": "view.value", "humidity": "purchase.value"}, {}, {"dew_point": "dew"}),
        (5, "difference", {"minuend": "click_ratio", "subtrahend": "dew"}, {}, {"difference": "half_click"}),
    ],
    "bp-2": [
        (1, "ppb_to_ugm3", {"ppb": "view.value", "temperature": "error.value"}, {"molar_mass_g": 48}, {"mass": "ozone"}),
    ],
}


def steps_table(t):
    rows = [
        (blueprint, order, name, inputs, json.dumps(params), outputs)
        for blueprint, steps in RECIPES.items()
        for order, name, inputs, params, outputs in steps
    ]
    from ..schemas import BLUEPRINT_STEP

    return t.spark.createDataFrame(rows, BLUEPRINT_STEP)


_MEMBER_ALIGN = {
    **_ALIGN,
    "span": f"""SELECT v.*, CAST(COALESCE(reading_interval_seconds, 60) AS BIGINT) * 500000 AS reach
        FROM vals v JOIN dev ON dev.device_id = v.node_id AND dev.mesh_id = v.mesh_id
        WHERE postprocessing_blueprint_id = 'bp-1' AND time >= {AS_OF_SQL} - INTERVAL 30 DAY""",
    "computed": """SELECT *, CASE WHEN ok THEN 243.04 * g / (17.625 - g) END AS dew, c * 0.5 + 1 AS half, CASE WHEN w <> 0 THEN (c * 0.5 + 1) / w END AS ratio
        FROM (SELECT *, p > 0 AND p <= 100 AS ok, CASE WHEN p > 0 AND p <= 100 THEN ln(p / 100) END + 17.625 * w / (243.04 + w) AS g FROM aligned)""",
    "written": """SELECT mesh_id, node_id, time, f.field, f.value, f.written_by, f.step_order FROM computed, LATERAL (
          SELECT 'half_click' AS field, half AS value, 1 AS written_by, 5 AS step_order
          UNION ALL SELECT 'click_ratio', ratio, 2, 2
          UNION ALL SELECT 'dew', dew, 4, 4
          UNION ALL SELECT 'half_click', ratio - dew, 5, 5) f WHERE f.value IS NOT NULL""",
}


def _blueprint(t, blueprint_id="bp-1"):
    return quality_scan.run_blueprint(
        blueprint_id, steps_table(t), t.devices(), t.points(("value",)), t.types(), AS_OF, "-30d"
    )


@query(
    "b01_b04_blueprint_run",
    with_views(
        f"""SELECT mesh_id, node_id, 'bp-1' AS blueprint_id, CAST(step_order AS BIGINT) AS step_order, CAST(written_by AS BIGINT) AS written_by,
               field, {stamp('time')} AS time, round(value, 6) AS value FROM written""",
        "vals",
        "dev",
        **_MEMBER_ALIGN,
    ),
)
def blueprint_run(t):
    return _blueprint(t).derived


@query(
    "b04_second_blueprint",
    with_views(
        f"""SELECT mesh_id, node_id, {stamp('base.time')} AS time, round(w * 48 * (101325 / 8.314462618) / (value + 273.15) / 1000, 6) AS value
        FROM base JOIN w USING (mesh_id, node_id, time)""",
        "vals",
        "dev",
        span=_MEMBER_ALIGN["span"].replace("bp-1", "bp-2"),
        base="SELECT * FROM span WHERE channel = 'error.value'",
        w=_nearest("w", "view.value"),
    ),
)
def second_blueprint(t):
    return _blueprint(t, "bp-2").derived.select("mesh_id", "node_id", "time", "value")


@query(
    "s07_derived_points",
    with_views(
        f"""SELECT mesh_id, node_id, 'derived' AS measurement, 'derived.' || field AS channel, 'bp-1' AS blueprint_id,
               CAST(step_order AS VARCHAR) AS step_order, {stamp('time')} AS time, round(value, 6) AS value FROM written""",
        "vals",
        "dev",
        **_MEMBER_ALIGN,
    ),
)
def derived_points(t):
    rows = _blueprint(t).points
    tag = lambda n: F.col("tags")[n].alias(n)
    return rows.select("mesh_id", "node_id", "measurement", "channel", tag("blueprint_id"), tag("step_order"), "time", "value")


def _renumbered(sql: str) -> str:
    return sql.replace("base b", "base2 b").replace("span o", "span2 o")


@query(
    "b04_s07_s08_fleet_scan",
    with_views(
        f"""SELECT mesh_id, node_id, 'derived' AS measurement, field, 'bp-1' AS made_of, {stamp('time')} AS time, round(arg_max(value, written_by), 6) AS value
        FROM written GROUP BY mesh_id, node_id, field, time
        UNION ALL
        SELECT mesh_id, node_id, 'derived', 'ozone', 'bp-2', {stamp('base2.time')}, round(w2 * 48 * (101325 / 8.314462618) / (value + 273.15) / 1000, 6)
        FROM base2 JOIN w2 USING (mesh_id, node_id, time)
        UNION ALL
        SELECT mesh_id, node_id, 'quality', field, channel, {stamp(AS_OF_SQL)}, round(value, 6) FROM (
          UNPIVOT (SELECT mesh_id, node_id, channel, ratio::DOUBLE AS completeness_ratio, observed::DOUBLE AS observed, expected::DOUBLE AS expected,
                     gap::DOUBLE AS largest_gap_seconds FROM stats)
          ON completeness_ratio, observed, expected, largest_gap_seconds INTO NAME field VALUE value)""",
        "vals",
        "dev",
        "meas",
        "var",
        **_MEMBER_ALIGN,
        **health._STATS,
        span2=_MEMBER_ALIGN["span"].replace("bp-1", "bp-2"),
        base2="SELECT * FROM span2 WHERE channel = 'error.value'",
        w2=_renumbered(_nearest("w2", "view.value")),
    ),
)
def fleet_scan_points(t):
    """One scan over all devices and blueprints; its points are read from the store.
    They are of one batch, within which copies were folded on writing."""
    root = f"{shared_folder(t.spark)}/scan-{uuid4().hex}"
    channels = health.known_channels(t)
    paths = fleet_scan.scan_fleet(
        t.points(("value",)), channels, t.devices(), t.variants(), steps_table(t), t.types(), root, 1, AS_OF, "-30d", "-30d"
    )
    made_of = F.coalesce(F.col("tags")["blueprint_id"], F.col("tags")["channel"]).alias("made_of")
    points = store.read_points(t.spark, paths.points, deduplicate=False)
    return points.select("mesh_id", "node_id", "measurement", "field", made_of, "time", "value")


# --- blueprints as data ----------------------------------------------------

_OWN_SPAN = f"""SELECT v.*, CAST(COALESCE(reading_interval_seconds, 60) AS BIGINT) * 500000 AS reach
    FROM vals v JOIN dev ON dev.device_id = v.node_id AND dev.mesh_id = v.mesh_id WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY"""


@query(
    "b04_blueprint_per_device",
    with_views(
        f"""SELECT mesh_id, node_id, 'own-' || node_id AS blueprint_id, f.field, CAST(f.step_order AS BIGINT) AS step_order, {stamp('time')} AS time, round(f.value, 6) AS value
        FROM (SELECT base.*, w, base.value * (node_id % 7 + 1) + node_id % 3 AS scaled FROM base JOIN w USING (mesh_id, node_id, time)), LATERAL (
          SELECT 'scaled' AS field, 1 AS step_order, scaled AS value
          UNION ALL SELECT 'against_view', 2, CASE WHEN node_id % 2 = 0 THEN scaled - w WHEN w <> 0 THEN scaled / w END) f
        WHERE f.value IS NOT NULL""",
        "vals",
        "dev",
        span=_OWN_SPAN,
        base="SELECT * FROM span WHERE channel = 'click.value'",
        w=_nearest("w", "view.value"),
    ),
)
def blueprint_per_device(t):
    """Every device has a blueprint of its own; all run in one pass."""
    key, own = F.col("c_custkey"), F.concat(F.lit("own-"), F.col("c_custkey"))
    first = F.struct(
        F.lit(1).alias("order"), F.lit("linear").alias("function_name"), F.create_map(F.lit("value"), F.lit("click.value")).alias("inputs"),
        F.format_string('{"scale": %d, "offset": %d}', key % 7 + 1, key % 3).alias("params"), F.create_map(F.lit("value"), F.lit("scaled")).alias("outputs"),
    )
    pair = lambda a, b: F.create_map(F.lit(a), F.lit("scaled"), F.lit(b), F.lit("view.value"))
    even = key % 2 == 0
    second = F.struct(
        F.lit(2).alias("order"), F.when(even, "difference").otherwise("ratio").alias("function_name"),
        F.when(even, pair("minuend", "subtrahend")).otherwise(pair("numerator", "denominator")).alias("inputs"), F.lit("{}").alias("params"),
        F.create_map(F.when(even, "difference").otherwise("ratio"), F.lit("against_view")).alias("outputs"),
    )
    steps = t.raw("customer").select(own.alias("blueprint_id"), F.inline(F.array(first, second)))
    devices = t.devices().withColumn("postprocessing_blueprint_id", F.concat(F.lit("own-"), "device_id"))
    points = t.points(("value",), R.joined_by(steps))
    run = quality_scan.run_blueprints(steps, devices, points, t.types(), AS_OF, "-30d")
    return run.derived.select("mesh_id", "node_id", "blueprint_id", "field", "step_order", "time", "value")


# The scale keeps results off the ties of rounding.
_WINDOWED_STEPS = [
    (1, "linear", {"value": "click.value"}, {"scale": 0.123456789}, {"value": "scaled"}),
    (2, "rolling_mean", {"value": "scaled"}, {"seconds": 259_200}, {"mean": "three_days"}),
    (3, "exponential_smoothing", {"value": "three_days"}, {"alpha": 0.3}, {"smoothed": "smooth"}),
    (4, "rate_of_change", {"value": "scaled"}, {}, {"rate": "rate"}),
    (5, "difference", {"minuend": "scaled", "subtrahend": "smooth"}, {}, {"difference": "above"}),
]


@query(
    "b02_b03_windowed_steps",
    with_views(
        f"""SELECT mesh_id, node_id, f.field, {stamp('time')} AS time, round(f.value, 6) AS value FROM (
          SELECT r.*, s.smooth FROM rolled r JOIN smoothed s USING (node_id, i)), LATERAL (
          SELECT 'scaled' AS field, value UNION ALL SELECT 'three_days', mean UNION ALL SELECT 'smooth', smooth UNION ALL SELECT 'rate', rate UNION ALL SELECT 'above', value - smooth) f
        WHERE f.value IS NOT NULL""",
        "dev",
        hot="""SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS node_id, value * 0.123456789::DOUBLE AS value FROM events WHERE event_type = 'click'""",
        rolled=f"""SELECT mesh_id, node_id, ts AS time, value, row_number() OVER w AS i,
              avg(value) OVER (PARTITION BY node_id ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS mean,
              CASE WHEN epoch_us(ts) > lag(epoch_us(ts)) OVER w THEN (value - lag(value) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6) END AS rate
            FROM hot JOIN dev ON device_id = node_id WHERE ts >= {AS_OF_SQL} - INTERVAL 30 DAY WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id)""",
        smoothed="""WITH RECURSIVE s AS (SELECT node_id, i, mean AS smooth FROM rolled WHERE i = 1
            UNION ALL SELECT r.node_id, r.i, 0.3::DOUBLE * r.mean + 0.7::DOUBLE * s.smooth FROM s JOIN rolled r ON r.node_id = s.node_id AND r.i = s.i + 1)
            SELECT * FROM s""",
    ),
)
def windowed_steps(t):
    """Rolling mean, its smoothing, and rate of change as steps; one device has a third of all readings."""
    from ..schemas import BLUEPRINT_STEP

    events = t.events().withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
    points = events.join(t.mesh_of_node(), "user_id").select(
        "mesh_id", F.col("user_id").alias("node_id"), F.col("event_type").alias("measurement"), "time", F.col("event_id").alias("packet_id"),
        F.lit("value").alias("field"), "value", F.lit("double").alias("value_type"), F.concat("event_type", F.lit(".value")).alias("channel"),
    )
    steps = t.spark.createDataFrame([("windows", o, n, i, json.dumps(p), w) for o, n, i, p, w in _WINDOWED_STEPS], BLUEPRINT_STEP)
    devices = t.devices().withColumn("postprocessing_blueprint_id", F.lit("windows"))
    return quality_scan.run_blueprints(steps, devices, points, t.types(), AS_OF, "-30d").derived.select("mesh_id", "node_id", "field", "time", "value")


@query(
    "b06_s09_derived_discoveries",
    with_views(
        """SELECT DISTINCT mesh_id, node_id AS device_id, 'derived' AS payload_kind, field,
               CASE field WHEN 'half_click' THEN 'ratio' WHEN 'click_ratio' THEN 'ratio' ELSE 'degC' END AS unit FROM written""",
        "vals",
        "dev",
        **_MEMBER_ALIGN,
    ),
)
def derived_discoveries(t):
    rows = _blueprint(t).discoveries.select("mesh_id", "device_id", "payload_kind", "field_units", F.explode("fields").alias("field"))
    return rows.select("mesh_id", "device_id", "payload_kind", "field", F.col("field_units")[F.col("field")].alias("unit"))


@query(
    "a15_b03_failures",
    with_views(
        """SELECT 'dew_point' AS function_name, count(*) AS rows_skipped FROM computed WHERE dew IS NULL HAVING count(*) > 0""",
        "vals",
        "dev",
        **_MEMBER_ALIGN,
    ),
)
def failures(t):
    return _blueprint(t).failures


@query(
    "b05_run_status",
    with_views(
        """SELECT r.id, CASE WHEN d.id IS NULL THEN 'device_not_found' WHEN postprocessing_blueprint_id IS NULL THEN 'no_blueprint'
               WHEN postprocessing_blueprint_id <> 'bp-1' THEN 'other_blueprint'
               WHEN COALESCE(c, 0) = 0 OR COALESCE(p, 0) = 0 OR COALESCE(w, 0) = 0 THEN 'no_data'
               WHEN COALESCE(n, 0) = 0 THEN 'no_aligned_rows' ELSE 'ok' END AS status,
               CASE WHEN postprocessing_blueprint_id = 'bp-1' THEN CASE WHEN COALESCE(c, 0) = 0 THEN 'click.value' WHEN COALESCE(p, 0) = 0 THEN 'purchase.value'
                    WHEN COALESCE(w, 0) = 0 THEN 'view.value' END END AS channel,
               CASE WHEN postprocessing_blueprint_id = 'bp-1' THEN COALESCE(n, 0) ELSE 0 END AS rows,
               CASE WHEN postprocessing_blueprint_id = 'bp-1' THEN COALESCE(m, 0) ELSE 0 END AS points_written
        FROM requested r LEFT JOIN dev d USING (id)
        LEFT JOIN (SELECT node_id, mesh_id, count(*) AS n FROM aligned GROUP BY node_id, mesh_id) a ON a.node_id = d.device_id AND a.mesh_id = d.mesh_id
        LEFT JOIN (SELECT node_id, mesh_id, count(*) AS m FROM written GROUP BY node_id, mesh_id) x ON x.node_id = d.device_id AND x.mesh_id = d.mesh_id
        LEFT JOIN (SELECT node_id, mesh_id, count_if(channel = 'click.value') AS c, count_if(channel = 'purchase.value') AS p,
                          count_if(channel = 'view.value') AS w FROM vals GROUP BY node_id, mesh_id) s ON s.node_id = d.device_id AND s.mesh_id = d.mesh_id""",
        "vals",
        "dev",
        **_MEMBER_ALIGN,
        requested="SELECT CASE WHEN c_custkey % 17 = 16 THEN 'gone-' ELSE 'dev-' END || c_custkey AS id FROM customer",
    ),
)
def run_status(t):
    key = F.col("c_custkey")
    requested = t.raw("customer").select(
        F.concat(F.when(key % 17 == 16, "gone-").otherwise("dev-"), key).alias("id")
    )
    readings = in_range(t.points(("value",)), resolve_bound("-30d", AS_OF))
    return B.run_status(B.load_steps(steps_table(t), "bp-1"), requested, t.devices(), readings, "bp-1")


_STEPS_SQL = """SELECT 'bp-' || l_orderkey AS blueprint_id, l_linenumber AS ord,
    CASE l_returnflag WHEN 'A' THEN 'linear' WHEN 'N' THEN 'ratio' ELSE 'unheard_of' END AS function_name,
    'c.' || (l_partkey % 50) AS in1,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'd.' || (l_suppkey % 50) END END AS in2,
    'c.' || (l_suppkey % 50) AS out1 FROM lineitem"""


def _many_steps(t):
    """Blueprints made of orders, their steps of the order lines."""
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "linear").when(flag == "N", "ratio").otherwise("unheard_of")
    first = F.concat(F.lit("c."), F.col("l_partkey") % 50)
    second = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("d."), F.col("l_suppkey") % 50))
    return t.raw("lineitem").select(
        F.concat(F.lit("bp-"), "l_orderkey").alias("blueprint_id"),
        F.col("l_linenumber").alias("order"),
        name.alias("function_name"),
        F.when(flag == "N", F.create_map(F.lit("numerator"), first, F.lit("denominator"), second))
        .otherwise(F.create_map(F.lit("value"), first))
        .alias("inputs"),
        F.lit("{}").alias("params"),
        F.create_map(F.lit("value"), F.concat(F.lit("c."), F.col("l_suppkey") % 50)).alias("outputs"),
    )


_USED = """used AS (SELECT DISTINCT blueprint_id, channel FROM (SELECT blueprint_id, in1 AS channel FROM steps
    UNION ALL SELECT blueprint_id, in2 FROM steps WHERE in2 IS NOT NULL)
    WHERE (blueprint_id, channel) NOT IN (SELECT blueprint_id, out1 FROM steps))"""


@query("u03_required_channels", f"WITH steps AS ({_STEPS_SQL}), {_USED} SELECT * FROM used")
def required_channels(t):
    return B.required_channels_table(_many_steps(t))


@query(
    "j06_device_requirements",
    f"""WITH steps AS ({_STEPS_SQL}), {_USED} SELECT 'mesh-' || c_nationkey AS mesh_id, c_custkey AS device_id, blueprint_id, channel
    FROM customer JOIN used ON blueprint_id = 'bp-' || c_custkey""",
)
def device_requirements(t):
    devices = t.devices().withColumn("postprocessing_blueprint_id", F.concat(F.lit("bp-"), "device_id"))
    return B.device_requirements(devices, _many_steps(t)).select("mesh_id", "device_id", "blueprint_id", "channel")


@query(
    "b07_l03_blueprint_validity",
    f"""WITH steps AS ({_STEPS_SQL}), per AS (SELECT blueprint_id, ord, count(*) AS n, count_if(function_name = 'unheard_of') AS u,
             count_if(function_name = 'ratio' AND in2 = '') AS b FROM steps GROUP BY blueprint_id, ord),
      agg AS (SELECT blueprint_id, sum(n) AS steps, count_if(n > 1) AS rep, sum(u) AS unk, sum(b) AS unb FROM per GROUP BY blueprint_id)
    SELECT 'bp-' || o_orderkey AS blueprint_id, CAST(COALESCE(steps, 0) AS BIGINT) AS steps, CAST(COALESCE(rep, 0) AS BIGINT) AS repeated_orders,
           CAST(COALESCE(unk, 0) AS BIGINT) AS unknown_functions, CAST(COALESCE(unb, 0) AS BIGINT) AS unbound_steps,
           COALESCE(steps, 0) > 0 AND rep = 0 AND unk = 0 AND unb = 0 AS is_valid
    FROM orders LEFT JOIN agg ON blueprint_id = 'bp-' || o_orderkey""".replace("COALESCE(steps, 0) > 0 AND rep = 0 AND unk = 0 AND unb = 0", "COALESCE(steps > 0 AND rep = 0 AND unk = 0 AND unb = 0, FALSE)"),
)
def blueprint_validity(t):
    return B.validate_blueprints(
        t.raw("orders").select(F.concat(F.lit("bp-"), "o_orderkey").alias("blueprint_id")), _many_steps(t)
    )
