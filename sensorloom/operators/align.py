"""Nearest-in-time alignment of independently sampled channels (J-05, W-04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: samples within this share of the alignment interval match.
TOLERANCE = 0.5
DEFAULT_INTERVAL_SECONDS = 60
# Slices are at least this wide, so that few samples sit near a border.
MIN_SLICE_SECONDS = 86_400


def of_channels(readings: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Readings of some channels. Where the table has measurement and field,
    these are named as well: the scan prunes by them, not by their join."""
    if {"measurement", "field"} <= set(readings.columns):
        parts = [c.partition(".") for c in channels]
        readings = readings.where(F.col("measurement").isin(*{m for m, _, _ in parts})).where(
            F.col("field").isin(*{f for _, _, f in parts})
        )
    return readings.where(F.col("channel").isin(*channels))


def align_nearest(
    readings: DataFrame,
    channels: Sequence[str],
    keys: Sequence[str] = ("mesh_id", "node_id"),
    interval: Column | float = DEFAULT_INTERVAL_SECONDS,
    time: str = "time",
    value: str = "value",
    tie: Sequence[str] = (),
    min_slice_seconds: int = MIN_SLICE_SECONDS,
) -> DataFrame:
    """One row per base reading that has a match in every other channel.

    The base is the first channel in name order. Every other channel supplies
    its sample nearest to the base time, at most half an interval away, the
    bound included; of two equally near ones the later wins, and of samples
    at one instant the last in `tie` order. Returns the keys, the base time
    and one column per channel, named as the channel.

    Rows are partitioned by (device, time slice). A slice is no narrower than
    the interval, so a sample can only be needed in its own slice and the one
    next to it: it is copied into at most two. All channels are matched in
    the same two sorts of one shuffle.
    """
    if not channels:
        # Nothing to align on: no rows.
        return readings.limit(0).select(*keys, F.col(time).alias("time"))
    base, *others = sorted(set(channels))
    interval = interval if isinstance(interval, Column) else F.lit(float(interval))
    wanted = of_channels(readings, [base, *others]).where(F.col(value).isNotNull())
    if not others:
        return wanted.where(F.col("channel") == base).select(
            *keys, F.col(time).alias("time"), F.col(value).alias(base)
        )

    us = F.col("_us")
    reach = F.floor(interval * (TOLERANCE * 1e6)).cast("long")
    width = (F.greatest(F.ceil(interval), F.lit(min_slice_seconds)) * 1_000_000).cast("long")
    placed = wanted.select(
        *keys,
        "channel",
        F.unix_micros(time).alias("_us"),
        F.col(value).alias("_value"),
        *[F.col(name).alias(f"_tie{i}") for i, name in enumerate(tie)],
        reach.alias("_reach"),
        width.alias("_width"),
    )
    ties = [f"_tie{i}" for i in range(len(tie))]
    number = lambda moment: F.floor(moment / F.col("_width"))
    first = F.when(F.col("channel") == base, number(us)).otherwise(number(us - F.col("_reach")))
    last = F.when(F.col("channel") == base, number(us)).otherwise(number(us + F.col("_reach")))
    sliced = placed.withColumn("_slice", F.explode(F.sequence(first, last)))

    sample = F.struct(us.alias("us"), F.col("_value").alias("value"))
    sliced = sliced.withColumn("_is_base", (F.col("channel") == base).cast("int"))
    slot = Window.partitionBy(*keys, "_slice")
    # Forward: latest sample at or before; at one instant the last in tie order.
    # Backward: earliest sample at or after; reversed, the last in tie order
    # must again come closest to the base row. Looking back from the far end is
    # linear, while a frame that opens at the current row is quadratic.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forward = slot.orderBy("_us", "_is_base", *ties).rowsBetween(*so_far)
    backward = slot.orderBy(F.desc("_us"), "_is_base", *ties).rowsBetween(*so_far)

    def last_of(name: str, window) -> Column:
        return F.last(F.when(F.col("channel") == name, sample), ignorenulls=True).over(window)

    matched = sliced.withColumns({f"_p{i}": last_of(c, forward) for i, c in enumerate(others)})
    matched = matched.withColumns({f"_n{i}": last_of(c, backward) for i, c in enumerate(others)})

    rows = matched.where(F.col("channel") == base)
    picked = [*keys, F.timestamp_micros(us).alias("time"), F.col("_value").alias(base)]
    for i, name in enumerate(others):
        before, after = F.col(f"_p{i}"), F.col(f"_n{i}")
        to_before = us - before["us"]
        to_after = after["us"] - us
        use_after = after.isNotNull() & (before.isNull() | (to_after <= to_before))
        distance = F.when(use_after, to_after).otherwise(to_before)
        rows = rows.where(distance <= F.col("_reach"))
        picked.append(F.when(use_after, after["value"]).otherwise(before["value"]).alias(name))
    return rows.select(*picked)
