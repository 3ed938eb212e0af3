"""The three read queries: timeseries, latest and metrics.

Each works for a set of devices and returns a DataFrame. `devices` limits it
to (mesh_id, node_id) rows; `None` means all devices the table holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.bounds import parse_aggregate, parse_identifier, resolve_bound
from ..functions.channels import origin_of_measurement
from ..operators.quality import alarm_counts, channel_quality, device_metrics
from ..operators.registry import describe_readings
from ..operators.series import downsample, in_range, latest

SHOWN = ("value", "value_str", "value_bool", "value_type")
SERIES = ("mesh_id", "node_id", "measurement", "field")


def of_devices(points: DataFrame, devices: DataFrame | None) -> DataFrame:
    if devices is None:
        return points
    wanted = devices.select("mesh_id", "node_id").distinct()
    return points.join(wanted, ["mesh_id", "node_id"], "left_semi")


def devices_by_id(devices: DataFrame, ids: DataFrame) -> DataFrame:
    """Registration ids as (mesh_id, node_id) rows."""
    return devices.join(ids.select("id"), "id", "left_semi").select(
        "mesh_id", F.col("device_id").alias("node_id")
    )


def timeseries(
    points: DataFrame,
    measurement: str,
    as_of: datetime,
    field: str | None = None,
    start: str = "-1h",
    stop: str = "now()",
    window: str | None = None,
    agg: str = "mean",
    devices: DataFrame | None = None,
    per_series: bool = False,
) -> DataFrame:
    """Readings of a measurement in [start, stop), raw or downsampled.

    Raw reads keep text and boolean fields; downsampling is for numbers.
    Readings of one field are one series whichever gateway heard them;
    `per_series` keeps gateways and channels apart.
    """
    parse_identifier(measurement, "measurement")
    if field is not None:
        parse_identifier(field, "field")
    parse_aggregate(agg)
    begin, end = resolve_bound(start, as_of, "start"), resolve_bound(stop, as_of, "stop")
    rows = points.where(F.col("measurement") == measurement)
    if field:
        rows = rows.where(F.col("field") == field)
    rows = of_devices(in_range(rows, begin, end), devices)
    keys = (*SERIES, "gateway_id", "channel_id") if per_series else SERIES
    if window:
        return downsample(rows, window, (agg,), end, keys).withColumnRenamed(agg, "value")
    shown = [c for c in SHOWN if c in points.columns]
    return rows.select(*keys, "time", *shown)


def latest_readings(
    points: DataFrame,
    as_of: datetime,
    measurement: str | None = None,
    lookback: str = "-30d",
    types: DataFrame | None = None,
    devices: DataFrame | None = None,
    tie: Sequence[str] = ("packet_id",),
) -> DataFrame:
    """Newest value per field; with a catalog, units and origin as well."""
    rows = in_range(points, resolve_bound(lookback, as_of, "lookback"))
    if measurement:
        parse_identifier(measurement, "measurement")
        rows = rows.where(F.col("measurement") == measurement)
    found = latest(of_devices(rows, devices), SERIES, [c for c in SHOWN if c in points.columns], tie)
    if types is not None:
        return describe_readings(found, types)
    return found.withColumn("origin", origin_of_measurement(F.col("measurement")))


def metrics(
    points: DataFrame,
    as_of: datetime,
    start: str = "-1h",
    stop: str = "now()",
    devices: DataFrame | None = None,
) -> DataFrame:
    """Quality figures per device from the stored quality and alarm points."""
    begin, end = resolve_bound(start, as_of, "start"), resolve_bound(stop, as_of, "stop")
    rows = of_devices(in_range(points, begin, end), devices)
    return device_metrics(
        rows.where(F.col("measurement") == "quality"), rows.where(F.col("measurement") == "alarms")
    )


def metrics_by_channel(points: DataFrame, as_of: datetime, start: str = "-1h", stop: str = "now()") -> DataFrame:
    """The per-channel part of `metrics`, one row per channel."""
    begin, end = resolve_bound(start, as_of, "start"), resolve_bound(stop, as_of, "stop")
    return channel_quality(in_range(points, begin, end))


def metrics_by_detector(points: DataFrame, as_of: datetime, start: str = "-1h", stop: str = "now()") -> DataFrame:
    begin, end = resolve_bound(start, as_of, "start"), resolve_bound(stop, as_of, "stop")
    return alarm_counts(in_range(points, begin, end))
