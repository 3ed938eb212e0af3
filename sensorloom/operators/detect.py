"""Detectors over ordered readings, and the alarms they raise."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .changelog import latest_per_key
from .sliced import DAY, run_position

ALARM_COLUMNS = (
    "mesh_id",
    "device_id",
    "channel",
    "detector",
    "source",
    "value",
    "message",
    "triggered_at",
)

# Readings in a flat run by default, its least and largest
# length, and the hours a sensor may stay flat.
FLAT_DEFAULT, FLAT_LEAST, FLAT_MOST, FLAT_HOURS = 5, 3, 240, 3.0
# Fixed value: publish intervals a device may be silent for.
SILENT_INTERVALS = 3

# Parts a channel's readings are dealt to where limits are looked up.
SALTS = 64

# Alarm texts.
STUCK_TEXT = "Value stuck at %s for %d consecutive readings"
RANGE_TEXT = "Value %s outside configured range [%s, %s]"


def plain_number(value: Column) -> Column:
    """A double as people write it: 12345678.0, 0.0001 and 1e+16; exponents only
    from 1e16 on and below 1e-4. The streaming tier writes numbers alike."""
    text = value.cast("string")
    size = F.abs(value)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.substring_index(text, "E", -1).cast("int")
    short = F.format_string(
        "%se%s%02d",
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""),
        F.when(power < 0, "-").otherwise("+"),
        F.abs(power),
    )
    return (
        F.when(value.isNull(), F.lit(None))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(short)
    )


def as_alarms(
    rows: DataFrame,
    detector: str,
    message: Column,
    triggered_at: Column,
    value: Column | None = None,
    channel: Column | None = None,
    device: str = "node_id",
    source: str = "batch",
) -> DataFrame:
    """R-07: rows in the one alarm shape of both tiers."""
    return rows.select(
        F.col("mesh_id") if "mesh_id" in rows.columns else F.lit(None).cast("string").alias("mesh_id"),
        F.col(device).cast("long").alias("device_id"),
        (channel if channel is not None else F.lit(None)).cast("string").alias("channel"),
        F.lit(detector).alias("detector"),
        F.lit(source).alias("source"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        message.alias("message"),
        triggered_at.alias("triggered_at"),
    )


def flat_window(interval: Column, hours: float = FLAT_HOURS) -> Column:
    """W-05: readings that make a run flat, from the reading interval."""
    readings = F.floor(F.lit(hours * 3600) / interval)
    bounded = F.greatest(F.lit(FLAT_LEAST), F.least(F.lit(FLAT_MOST), readings))
    return F.when(F.coalesce(interval, F.lit(0)) == 0, FLAT_DEFAULT).otherwise(bounded).cast("int")


def flat_readings(
    readings: DataFrame,
    keys: Sequence[str],
    window: Column | int = FLAT_DEFAULT,
    order: Sequence[str] = ("time", "packet_id"),
    width_seconds: int = DAY,
) -> DataFrame:
    """W-01: readings at which the last `window` values of a series are equal.

    Every further equal reading qualifies as well. NaN never equals itself
    upstream, so NaN readings are left out first, as are missing values and
    readings of a type that is no number.
    """
    usable = readings.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if "value_type" in readings.columns:
        usable = usable.where(F.col("value_type").isin("double", "long"))
    return run_position(usable, keys, order, width_seconds=width_seconds, at_least=window)


def stuck_value(
    readings: DataFrame, keys: Sequence[str] = ("mesh_id", "node_id", "field"), window: int = FLAT_DEFAULT
) -> DataFrame:
    """R-01."""
    return stuck_alarms(flat_readings(readings, keys, window), window, keys[-1])


def stuck_alarms(stuck: DataFrame, window: int = FLAT_DEFAULT, field: str = "field") -> DataFrame:
    message = F.format_string(STUCK_TEXT, plain_number(F.col("value")), F.lit(window))
    return as_alarms(stuck, "stuck_value", message, F.col("time"), F.col("value"), F.col(field), source="stream")


def flat_value(readings: DataFrame, hours: float = FLAT_HOURS) -> DataFrame:
    """R-03: R-01 per channel, its window set by `interval_seconds`."""
    sized = readings.withColumn("flat_window", flat_window(F.col("interval_seconds"), hours))
    flat = flat_readings(sized, ("mesh_id", "node_id", "channel"), F.col("flat_window"))
    message = F.format_string(STUCK_TEXT, plain_number(F.col("value")), "flat_window")
    return as_alarms(
        flat, "flat_value", message, F.col("time"), F.col("value"), F.col("channel"), source="stream"
    )


def outside(value: Column, low: Column, high: Column) -> Column:
    """Beyond a bound; the bounds themselves are fine, a missing one is open."""
    return F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))


def rules_by_key(changes: DataFrame) -> DataFrame:
    """J-04: live range rules keyed `node_id:field`."""
    bounds = F.from_json("params", "min double, max double")
    live = latest_per_key(changes).where(
        F.coalesce("detector_name", F.lit("range_check")) == "range_check"
    )
    return live.select(
        F.col("key").alias("_rule"), bounds["min"].alias("low"), bounds["max"].alias("high")
    )


def range_check(readings: DataFrame, changes: DataFrame) -> DataFrame:
    """R-02."""
    keyed = readings.withColumn("_rule", F.concat_ws(":", F.col("node_id").cast("string"), "field"))
    found = keyed.join(rules_by_key(changes), "_rule").where(
        outside(F.col("value"), F.col("low"), F.col("high"))
    )
    return _range_alarms(found, "range_check", F.col("field"))


def plausibility(readings: DataFrame, config: DataFrame) -> DataFrame:
    """R-04: R-02 with the catalog's limits per channel (J-14).

    There are few channels and many readings of each. A channel's limits are
    repeated under `SALTS` numbers and its readings dealt to them, so a shuffle,
    if the engine needs one, spreads a channel over as many partitions.
    """
    numbers = F.sequence(F.lit(0), F.lit(SALTS - 1))
    limits = config.select(
        "channel", F.col("valid_min").alias("low"), F.col("valid_max").alias("high"), F.explode(numbers).alias("_salt")
    )
    dealt = readings.withColumn("_salt", F.pmod(F.xxhash64("time", "node_id"), F.lit(SALTS)).cast("int"))
    found = dealt.join(limits, ["channel", "_salt"]).where(outside(F.col("value"), F.col("low"), F.col("high")))
    return _range_alarms(found, "plausibility", F.col("channel"))


def _range_alarms(found: DataFrame, detector: str, channel: Column) -> DataFrame:
    text = lambda name: F.coalesce(plain_number(F.col(name)), F.lit("None"))
    message = F.format_string(RANGE_TEXT, text("value"), text("low"), text("high"))
    return as_alarms(found, detector, message, F.col("time"), F.col("value"), channel, source="stream")


def absence(devices: DataFrame, last_seen: DataFrame, as_of: datetime) -> DataFrame:
    """T-08, batch form: devices silent for over three publish intervals.

    Devices without a publish interval are not watched, nor are devices that
    were never heard.
    """
    watched = devices.where(F.coalesce("publish_interval_seconds", F.lit(0)) > 0).select(
        "mesh_id", F.col("device_id").alias("node_id"), "publish_interval_seconds"
    )
    silence = (F.unix_micros(F.lit(as_of)) - F.unix_micros("last_time")) / 1e6
    silent = (
        watched.join(last_seen.select("mesh_id", "node_id", "last_time"), ["mesh_id", "node_id"])
        .withColumn("_silence", silence)
        .where(F.col("_silence") > F.col("publish_interval_seconds") * SILENT_INTERVALS)
    )
    message = F.format_string(
        f"No packet for %.0fs, over {SILENT_INTERVALS}x the %ds publish interval",
        "_silence",
        "publish_interval_seconds",
    )
    return as_alarms(silent, "absence", message, F.lit(as_of).cast("timestamp"), source="stream")
