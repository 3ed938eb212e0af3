"""Range reads, downsampling and latest values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bounds import AGGREGATES, resolve_bound
from ..operators import registry as R, series as S
from ..plans import telemetry
from ..sources import store
from .registry import query
from .tables import AS_OF, AS_OF_SQL, stamp, with_views

SERIES = ("mesh_id", "node_id", "measurement", "field")
_KEYS = "mesh_id, node_id, measurement, field"
_EPOCH = "TIMESTAMP '1970-01-01'"


def _bucket(step: str) -> str:
    return f"least(time_bucket(INTERVAL {step}, time, {_EPOCH}) + INTERVAL {step}, {AS_OF_SQL})"


@query(
    "a01_downsample",
    with_views(
        f"""SELECT {_KEYS}, {stamp(_bucket('6 HOUR'))} AS time, round(avg(value), 6) AS mean,
               round(max(value), 6) AS max, round(min(value), 6) AS min, round(arg_max(value, time), 6) AS last,
               round(arg_min(value, time), 6) AS first, round(sum(value), 6) AS sum, count(*) AS count
        FROM pts WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY AND time < {AS_OF_SQL}
        GROUP BY {_KEYS}, {_bucket('6 HOUR')}""",
        "pts",
    ),
)
def downsample_all(t):
    rows = S.in_range(t.points(), *_range("-30d"))
    # One reading per series and instant: nothing to break ties over.
    return S.downsample(rows, "6h", AGGREGATES, AS_OF, tie=())


def _range(start: str, stop: str = "now()"):
    return resolve_bound(start, AS_OF), resolve_bound(stop, AS_OF)


@query(
    "a01_downsample_weeks",
    with_views(
        f"""SELECT {_KEYS}, {stamp(_bucket('7 DAY'))} AS time, round(max(value), 6) AS max
        FROM pts WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY AND time < {AS_OF_SQL}
        GROUP BY {_KEYS}, {_bucket('7 DAY')}""",
        "pts",
    ),
)
def downsample_weeks(t):
    return S.downsample(S.in_range(t.points(), *_range("-30d")), "1w", ("max",), AS_OF)


@query(
    "a01_downsample_months",
    with_views(
        f"""SELECT {_KEYS}, {stamp("date_trunc('month', time) + INTERVAL 1 MONTH")} AS time,
               round(avg(value), 6) AS mean, count(*) AS count
        FROM pts GROUP BY {_KEYS}, date_trunc('month', time)""",
        "pts",
    ),
)
def downsample_months(t):
    return S.downsample(t.points(), "1mo", ("mean", "count"))


@query(
    "a01_timeseries_windowed",
    with_views(
        f"""SELECT {_KEYS}, {stamp(_bucket('12 HOUR'))} AS time, round(avg(value), 6) AS value
        FROM pts WHERE measurement = 'view' AND field = 'value'
          AND time >= {AS_OF_SQL} - INTERVAL 7 DAY AND time < {AS_OF_SQL}
        GROUP BY {_KEYS}, {_bucket('12 HOUR')}""",
        "pts",
    ),
)
def timeseries_windowed(t):
    return telemetry.timeseries(t.points(), "view", AS_OF, "value", "-7d", "now()", "12h")


@query(
    "a02_timeseries_raw",
    with_views(
        f"""SELECT {_KEYS}, {stamp('time')} AS time, round(value, 6) AS value,
               CASE field WHEN 'k' THEN 'long' ELSE 'double' END AS value_type
        FROM pts WHERE measurement = 'click' AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-12 06:00:00'""",
        "pts",
    ),
)
def timeseries_raw(t):
    return telemetry.timeseries(t.points(), "click", AS_OF, start="2024-01-10", stop="2024-01-12T06:00:00Z")


@query(
    "a03_latest_of_measurement",
    with_views(
        f"""SELECT {_KEYS}, round(arg_max(value, time), 6) AS value, {stamp('max(time)')} AS time
        FROM pts WHERE measurement = 'view' AND time >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY {_KEYS}""",
        "pts",
    ),
)
def latest_of_measurement(t):
    return telemetry.latest_readings(t.points().drop("value_type"), AS_OF, "view", tie=()).select(*SERIES, "value", "time")


@query(
    "a04_latest_all",
    with_views(
        f"""SELECT {_KEYS}, round(arg_max(value, time), 6) AS value, {stamp('max(time)')} AS time
        FROM pts WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY {_KEYS}""",
        "pts",
    ),
)
def latest_all(t):
    return telemetry.latest_readings(t.points().drop("value_type"), AS_OF, tie=()).select(*SERIES, "value", "time")


@query(
    "w03_latest_row_per_device",
    with_views(
        f"""SELECT mesh_id, node_id, arg_max(measurement, time) AS measurement, round(arg_max(value, time), 6) AS value,
               {stamp('max(time)')} AS time
        FROM vals GROUP BY mesh_id, node_id""",
        "vals",
    ),
)
def latest_row_per_device(t):
    return S.latest(t.points(("value",)), ("mesh_id", "node_id"), ("measurement", "value"))


@query(
    "j11_p26_described_readings",
    with_views(
        f"""SELECT {_KEYS}, round(arg_max(value, time), 6) AS value, {stamp('max(time)')} AS time,
               max(native_unit) AS unit, max(quantity_kind) AS quantity_kind, max(vocabulary_uri) AS vocabulary_uri,
               'measured' AS origin
        FROM pts LEFT JOIN typ ON split_part(payload_kind, ':', 2) = measurement AND field_name = field
        WHERE time >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY {_KEYS}""",
        "pts",
        "typ",
    ),
)
def described_readings(t):
    found = telemetry.latest_readings(t.points().drop("value_type"), AS_OF, types=t.types(), tie=())
    return found.select(*SERIES, "value", "time", "unit", "quantity_kind", "vocabulary_uri", "origin")


@query(
    "j12_owned_readings",
    with_views(
        f"""SELECT {_KEYS}, {stamp('time')} AS time, round(value, 6) AS value
        FROM vals WHERE mesh_id IN (SELECT mesh_id FROM mesh WHERE owner_id = 'owner-2')""",
        "vals",
        "mesh",
    ),
)
def owned_readings(t):
    return R.owned_by(t.points(("value",)), t.devices(), t.meshes(), "owner-2").select(*SERIES, "time", "value")


@query(
    "a14_series_form",
    with_views(
        f"""SELECT {_KEYS}, CAST(floor(epoch(time) / 86400) AS BIGINT) AS chunk,
               row_number() OVER (PARTITION BY {_KEYS}, floor(epoch(time) / 86400) ORDER BY time) - 1 AS position,
               {stamp('time')} AS time, round(value, 6) AS value
        FROM pts""",
        "pts",
    ),
)
def series_form(t):
    chunks = S.series_form(t.points())
    return chunks.select(*SERIES, "chunk", F.posexplode("points").alias("position", "_p")).select(
        *SERIES, "chunk", "position", "_p.time", "_p.value"
    )


@query(
    "s06_p21_channel_scan",
    with_views(
        f"""SELECT mesh_id, node_id, channel, {stamp('time')} AS time, round(value, 6) AS value
        FROM pts WHERE measurement = 'purchase' AND field = 'value' AND time >= {AS_OF_SQL} - INTERVAL 14 DAY
          AND EXISTS (SELECT 1 FROM dev WHERE dev.device_id = node_id AND dev.mesh_id = pts.mesh_id AND is_allowed)""",
        "pts",
        "dev",
    ),
)
def channel_scan(t):
    allowed = R.filter_devices(t.devices(), is_allowed=True)
    rows = store.read_channel(t.points(("value",)), "purchase.value", _range("-14d")[0], allowed)
    return rows.select("mesh_id", "node_id", "channel", "time", "value")


@query(
    "l01_readings_in_time_order",
    with_views(f"SELECT {stamp('time')} AS time, packet_id, channel, round(value, 6) AS value FROM vals", "vals"),
)
def readings_in_time_order(t):
    return S.order_series(t.points(("value",)), "time", "packet_id").select("time", "packet_id", "channel", "value")


@query(
    "l02_devices_in_order",
    with_views("SELECT mesh_id, device_id, name, role FROM dev", "dev"),
)
def devices_in_order(t):
    return S.order_series(t.devices(), "mesh_id", "device_id").select("mesh_id", "device_id", "name", "role")
