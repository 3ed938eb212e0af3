"""Ordered computations per series that never put a whole series in one task.

A plain `Window.partitionBy(series)` sends every reading of a series to one
task, and one device can hold a third of all readings. Here the rows are
partitioned by (series, time slice), which splits a busy series by time, and
only one summary row per slice is ordered per whole series.

The shuffle moves each row once. Summaries are `span / slice width` rows per
series, so a ten-year series in day slices has 3,650 of them. A day slice
holds a day's readings of a series from all gateways that heard it; where that
is too much for a task, give a smaller width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86_400
SLICE = "_slice"


def slice_of(time: Column, width_seconds: int) -> Column:
    """Number of the epoch-aligned time slice."""
    return F.floor(F.unix_micros(time) / F.lit(width_seconds * 1_000_000))


def gap_slices(
    readings: DataFrame, keys: Sequence[str], time: str = "time", width_seconds: int = DAY
) -> DataFrame:
    """Per series and slice: _n, _first, _last and _inner, the largest gap
    inside. Summaries of disjoint times can be merged by `merge_gap_slices`."""
    per_slice = Window.partitionBy(*keys, SLICE).orderBy("_us")
    return (
        readings.select(
            *keys,
            F.unix_micros(time).alias("_us"),
            slice_of(F.col(time), width_seconds).alias(SLICE),
        )
        .withColumn("_gap", F.col("_us") - F.lag("_us").over(per_slice))
        .groupBy(*keys, SLICE)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.max("_gap").alias("_inner"),
        )
    )


def merge_gap_slices(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary of each series over the slices given."""
    per_series = Window.partitionBy(*keys).orderBy("_first")
    return (
        slices.withColumn("_outer", F.col("_first") - F.lag("_last").over(per_series))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("observed"),
            F.timestamp_micros(F.min("_first")).alias("first_time"),
            F.timestamp_micros(F.max("_last")).alias("last_time"),
            (
                F.coalesce(
                    F.greatest(F.max("_inner"), F.max("_outer")).cast("double"), F.lit(0.0)
                )
                / 1e6
            ).alias("largest_gap_seconds"),
        )
    )


def gap_summary(
    readings: DataFrame, keys: Sequence[str], time: str = "time", width_seconds: int = DAY
) -> DataFrame:
    """Per series: observed, first_time, last_time and largest_gap_seconds.

    The largest gap is between consecutive readings; the stretches before the
    first and after the last one do not count, and fewer than two readings
    give 0.
    """
    return merge_gap_slices(gap_slices(readings, keys, time, width_seconds), keys)


def _without_nulls(rows: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Key columns with nulls replaced by values no key has."""
    kinds = dict(rows.dtypes)
    plain = {}
    for i, key in enumerate(keys):
        if kinds[key] == "string":
            plain[f"_key{i}"] = F.coalesce(key, F.lit("\u0000"))
        elif kinds[key] in ("bigint", "int"):
            plain[f"_key{i}"] = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
        else:
            raise TypeError(f"series key {key} is {kinds[key]}; use text or whole numbers")
    return plain


def run_position(
    readings: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str = "value",
    time: str = "time",
    width_seconds: int = DAY,
    into: str = "run_position",
    at_least: Column | int | None = None,
) -> DataFrame:
    """Add the 1-based position of each reading in its run of equal values.

    `order` must sort the readings of a series and start with `time`. Runs go
    on across slice borders: each slice learns from the slices before it how
    long the run it opens with already is.

    With `at_least` only readings at that position or beyond are returned.
    Short runs inside a slice are then dropped before its summary is joined.
    """
    # Stand-ins for null members make the keys joinable by plain equality, so
    # every step below is partitioned alike and the rows are shuffled once.
    plain = _without_nulls(readings, keys)
    spot = (*plain, SLICE)
    inside = Window.partitionBy(*spot).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        readings.withColumns(plain)
        .withColumn(SLICE, slice_of(F.col(time), width_seconds))
        .withColumn("_row", F.row_number().over(inside))
        .withColumn(
            "_starts",
            (F.col("_row") == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(inside)),
        )
        .withColumn("_start_row", F.max(F.when(F.col("_starts"), F.col("_row"))).over(so_far))
        .withColumn("_here", F.col("_row") - F.col("_start_row") + 1)
        .drop("_starts")
    )
    edges = rows.groupBy(*spot).agg(
        F.max("_row").alias("_n"),
        F.min_by(value, "_row").alias("_head"),
        F.max_by(value, "_row").alias("_tail"),
        F.max_by("_here", "_row").alias("_tail_run"),
    )
    by_slice = Window.partitionBy(*plain).orderBy(SLICE)
    before = lambda name: F.lag(name).over(by_slice)
    linked = (
        edges.withColumns({f"_prev{c}": before(c) for c in ("_n", "_tail", "_tail_run")})
        .withColumn(
            "_continues", F.col("_prev_n").isNotNull() & F.col("_head").eqNullSafe(F.col("_prev_tail"))
        )
        # The slice before is one single run exactly when its last run fills it.
        .withColumn(
            "_fresh", ~F.col("_continues") | (F.col("_prev_tail_run") != F.col("_prev_n"))
        )
        .withColumn("_chain", F.sum(F.col("_fresh").cast("long")).over(by_slice))
    )
    along_chain = Window.partitionBy(*plain, "_chain").orderBy(SLICE)
    carried = linked.select(
        *spot,
        F.sum(F.when(F.col("_continues"), F.col("_prev_tail_run")).otherwise(0))
        .over(along_chain)
        .alias("_carry"),
    )
    if at_least is not None:
        bound = at_least if isinstance(at_least, Column) else F.lit(at_least)
        rows = rows.where((F.col("_start_row") == 1) | (F.col("_here") >= bound))
    total = F.col("_here") + F.when(F.col("_start_row") == 1, F.coalesce("_carry", F.lit(0))).otherwise(0)
    placed = rows.join(carried, list(spot), "left").select(
        *readings.columns, total.cast("long").alias(into)
    )
    return placed if at_least is None else placed.where(F.col(into) >= bound)
