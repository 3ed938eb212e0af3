"""Completeness of channels, the alarms it raises and the device metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.units import QUALITY_FIELD_UNITS
from .detect import as_alarms
from .sliced import DAY, gap_summary

CHANNEL = ("mesh_id", "node_id", "channel")

# Least share of expected readings, and the reading intervals a
# gap may last.
LEAST_RATIO = 0.8
GAP_INTERVALS = 3


def reading_interval(device_interval: Column, variant_default: Column) -> Column:
    """J-07: the device's own interval, else the variant's; 0 counts as unset."""
    return F.nullif(
        F.coalesce(F.nullif(device_interval, F.lit(0)), variant_default), F.lit(0)
    )


def completeness(
    channels: DataFrame, readings: DataFrame, window_seconds: int, slice_seconds: int = DAY
) -> DataFrame:
    """A-05 for every channel that has an interval, including silent ones.

    `channels` has the channel key, interval_seconds and whatever else should
    be kept; `readings` is already cut to the window.
    """
    return completeness_of(channels, gap_summary(readings, CHANNEL, width_seconds=slice_seconds), window_seconds)


def completeness_of(channels: DataFrame, stats: DataFrame, window_seconds: int) -> DataFrame:
    """A-05 from the summaries of the channels over the window."""
    expected = F.greatest(
        F.lit(1), F.floor(F.lit(window_seconds) / F.greatest(F.lit(1), F.col("interval_seconds")))
    )
    return (
        channels.where(F.coalesce("interval_seconds", F.lit(0)) > 0)
        .join(stats.drop("first_time", "last_time"), list(CHANNEL), "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)).cast("long"))
        .withColumn("expected", expected.cast("long"))
        .withColumn("completeness_ratio", F.least(F.lit(1.0), F.col("observed") / F.col("expected")))
        .withColumn("largest_gap_seconds", F.coalesce("largest_gap_seconds", F.lit(0.0)))
    )


def completeness_alarms(stats: DataFrame, lookback: str, as_of: datetime) -> DataFrame:
    """R-05: too few readings, or else too long a gap; both strictly."""
    few = F.col("completeness_ratio") < LEAST_RATIO
    gap = F.col("largest_gap_seconds") > F.col("interval_seconds") * GAP_INTERVALS
    # The two alarm texts.
    few_text = F.format_string(
        f"Only %d of ~%d expected readings in {lookback} (%.0f%%) - the device published, but its "
        "history has gaps at the configured %ds reading interval",
        "observed",
        "expected",
        F.bround(F.col("completeness_ratio") * 100, 0),
        "interval_seconds",
    )
    gap_text = F.format_string(
        "Overall completeness is fine but there is a %.0fs hole, "
        f"over {GAP_INTERVALS}x the %ds reading interval",
        F.bround("largest_gap_seconds", 0),
        "interval_seconds",
    )
    return as_alarms(
        stats.where(few | gap),
        "completeness",
        F.when(few, few_text).otherwise(gap_text),
        F.lit(as_of).cast("timestamp"),
        F.when(few, F.col("completeness_ratio")).otherwise(F.col("largest_gap_seconds")),
        F.col("channel"),
    )


def quality_points(stats: DataFrame, as_of: datetime) -> DataFrame:
    """S-08: the four figures of a channel as points, null ones left out."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(name).cast("double").alias("value"))
            for name in QUALITY_FIELD_UNITS
        ]
    )
    rows = stats.select(
        "mesh_id",
        "node_id",
        F.create_map(F.lit("channel"), F.col("channel")).alias("tags"),
        F.explode(entries).alias("_f"),
    )
    return rows.where(F.col("_f.value").isNotNull()).select(
        "mesh_id",
        "node_id",
        F.lit(None).cast("string").alias("channel_id"),
        F.lit(None).cast("string").alias("gateway_id"),
        F.lit("quality").alias("measurement"),
        F.col("_f.field").alias("field"),
        F.concat_ws(".", F.lit("quality"), "_f.field").alias("channel"),
        F.col("_f.value").alias("value"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(None).cast("boolean").alias("value_bool"),
        F.lit("double").alias("value_type"),
        "tags",
        F.lit(None).cast("long").alias("packet_id"),
        F.lit(None).cast("string").alias("timestamp_quality"),
        F.lit(as_of).cast("timestamp").alias("time"),
    )


def quality_discoveries(stats: DataFrame, as_of: datetime) -> DataFrame:
    """R-08: devices with a result carry the four quality channels."""
    units = F.create_map(*[F.lit(x) for pair in QUALITY_FIELD_UNITS.items() for x in pair])
    return stats.select("mesh_id", F.col("node_id").alias("device_id")).distinct().select(
        "mesh_id",
        "device_id",
        F.lit("quality").alias("payload_kind"),
        F.array(*[F.lit(name) for name in sorted(QUALITY_FIELD_UNITS)]).alias("fields"),
        units.alias("field_units"),
        F.lit(as_of).cast("timestamp").alias("seen_at"),
        F.lit("upsert").alias("op"),
    )


def channel_quality(points: DataFrame, value: str = "value") -> DataFrame:
    """A-06: the last figures per channel, one column each."""
    rows = points.where(F.col("measurement") == "quality").withColumn("channel", F.col("tags")["channel"])
    return (
        rows.groupBy("mesh_id", "node_id", "channel")
        .agg(
            *[
                F.max_by(F.when(F.col("field") == name, F.col(value)), F.when(F.col("field") == name, F.col("time"))).alias(name)
                for name in QUALITY_FIELD_UNITS
            ]
        )
    )


def alarm_counts(points: DataFrame) -> DataFrame:
    """A-07: alarms per device and detector, each alarm counted once.

    Every alarm point has a message field, so that field stands for the alarm.
    """
    return (
        points.where((F.col("measurement") == "alarms") & (F.col("field") == "message"))
        .groupBy("mesh_id", "node_id", F.col("tags")["detector"].alias("detector"))
        .agg(F.count(F.lit(1)).alias("alarms"))
    )


def device_metrics(quality: DataFrame, alarms: DataFrame) -> DataFrame:
    """A-08: figures per device from A-06 and A-07."""
    ingested = (
        channel_quality(quality)
        .groupBy("mesh_id", "node_id")
        .agg(F.sum(F.coalesce("observed", F.lit(0.0))).alias("points_ingested"), F.count(F.lit(1)).alias("channels"))
    )
    raised = (
        alarm_counts(alarms)
        .groupBy("mesh_id", "node_id")
        .agg(
            F.sum("alarms").alias("alarms"),
            F.sum(F.when(F.col("detector") == "plausibility", F.col("alarms")).otherwise(0)).alias("_implausible"),
            # An alarm without a detector counts among all alarms only.
            F.map_from_entries(
                F.collect_list(F.when(F.col("detector").isNotNull(), F.struct("detector", "alarms")))
            ).alias("alarms_by_detector"),
        )
    )
    joined = ingested.join(raised, ["mesh_id", "node_id"], "full_outer")
    points = F.coalesce("points_ingested", F.lit(0.0))
    return joined.select(
        "mesh_id",
        "node_id",
        points.alias("points_ingested"),
        (1 - F.coalesce("_implausible", F.lit(0)) / F.nullif(points, F.lit(0.0))).alias("plausibility_ratio"),
        F.coalesce("alarms", F.lit(0)).alias("alarms"),
        F.coalesce("channels", F.lit(0)).alias("channels"),
        F.coalesce("alarms_by_detector", F.create_map().cast("map<string,bigint>")).alias("alarms_by_detector"),
    )
