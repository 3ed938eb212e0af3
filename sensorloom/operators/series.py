"""Range reads, downsampling and latest values over the points table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bounds import Duration, parse_aggregate, parse_window
from .sliced import DAY, slice_of

NUMERIC_TYPES = ("long", "double")
DEVICE = ("mesh_id", "node_id")
SERIES = ("mesh_id", "node_id", "measurement", "field")


def in_range(
    points: DataFrame, start: datetime | None = None, stop: datetime | None = None, time: str = "time"
) -> DataFrame:
    """Start included, stop excluded. Both are literals, so the scan sees them."""
    if start is not None:
        points = points.where(F.col(time) >= F.lit(start))
    if stop is not None:
        points = points.where(F.col(time) < F.lit(stop))
    return points


def numeric_only(points: DataFrame) -> DataFrame:
    return points.where(F.col("value_type").isin(*NUMERIC_TYPES))


def window_stop(time: Column, every: Duration) -> Column:
    """End of the epoch-aligned window a time falls in; months follow the calendar."""
    if every.months:
        month = F.year(time) * 12 + F.month(time) - 1 - 1970 * 12
        stop = (F.floor(month / every.months) + 1) * every.months
        return F.add_months(F.lit("1970-01-01").cast("date"), stop.cast("int")).cast("timestamp")
    width = every.micros
    return F.timestamp_micros((F.floor(F.unix_micros(time) / width) + 1) * width)


def _aggregate(name: str, value: Column, order: Column) -> Column:
    return {
        "mean": lambda: F.avg(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "first": lambda: F.min_by(value, order),
        "last": lambda: F.max_by(value, order),
    }[parse_aggregate(name)]()


def downsample(
    points: DataFrame,
    window: str,
    aggregates: Sequence[str] = ("mean",),
    stop: datetime | None = None,
    keys: Sequence[str] = SERIES,
    tie: Sequence[str] = ("packet_id",),
) -> DataFrame:
    """Tumbling-window aggregates; the row time is the window's end.

    Windows without readings are not made. A window that the range cuts off
    gets the range's stop as its time. Partial aggregation runs before the
    shuffle, so a busy series arrives as one row per task and window. `tie`
    is as for `latest` and matters to first and last only.
    """
    every = parse_window(window)
    end = window_stop(F.col("time"), every)
    if stop is not None:
        end = F.least(end, F.lit(stop))
    order = F.struct("time", *tie) if tie else F.col("time")
    return (
        numeric_only(points)
        .groupBy(*keys, end.alias("window_stop"))
        .agg(*[_aggregate(name, F.col("value"), order).alias(name) for name in aggregates])
        .withColumnRenamed("window_stop", "time")
    )


def latest(
    points: DataFrame,
    keys: Sequence[str] = SERIES,
    columns: Sequence[str] = ("value",),
    tie: Sequence[str] = ("packet_id",),
) -> DataFrame:
    """Most recent reading per key (A-03, A-04, W-03).

    An aggregate, not a ranking: each task sends one row per key. `tie` breaks
    equal times; where a key has at most one reading per instant, an empty
    one lets the engine aggregate by hash instead of by sort.
    """
    if not tie:
        newest = [F.max_by(name, "time").alias(name) for name in columns]
        return points.groupBy(*keys).agg(*newest, F.max("time").alias("time"))
    order = F.struct("time", *tie)
    packed = F.struct(*columns, "time")
    return (
        points.groupBy(*keys)
        .agg(F.max_by(packed, order).alias("_r"))
        .select(*keys, *[F.col(f"_r.{name}").alias(name) for name in columns], "_r.time")
    )


def series_form(
    points: DataFrame,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    tie: Sequence[str] = ("packet_id",),
    chunk_seconds: int = DAY,
) -> DataFrame:
    """Readings as arrays in time order, one row per series and time chunk (A-14).

    Concatenating the chunks of a series by `chunk` gives its whole list. A
    series is not folded into a single row, because nothing bounds its length.
    """
    entry = F.struct("time", *tie, F.col(value).alias("value"))
    return (
        points.groupBy(*keys, slice_of(F.col("time"), chunk_seconds).alias("chunk"))
        .agg(F.sort_array(F.collect_list(entry)).alias("points"))
        .withColumn(
            "points",
            F.transform("points", lambda p: F.struct(p["time"].alias("time"), p["value"].alias("value"))),
        )
    )


def order_series(df: DataFrame, *names: str) -> DataFrame:
    """Global presentation order, by range partitioning."""
    return df.orderBy(*names)
