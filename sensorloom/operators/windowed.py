"""Functions of a reading and the readings before it (B-02), for series of any length.

Rows are partitioned by (series, time slice), so a series that holds a third
of all rows is many tasks' work. What a slice needs of those before it comes
in one of three ways: as copies of the readings that still count in it (its
halo), as the last reading of the slice before, or as the value the slices
before lead to, found by composing one affine map per slice.

Parameters may be columns, so series with different ones are one pass.
Readings that are null or not finite, or have no time, are left out.
Members of `keys` that are null are values of their own. A parameter that is
missing or out of its range gives null results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86_400
_SLICE, _US, _X = "_slice", "_us", "_x"


def _param(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _placed(rows: DataFrame, value: str, time: str, width: int) -> DataFrame:
    us = F.unix_micros(time)
    usable = rows.where(F.col(time).isNotNull() & (F.abs(F.col(value).cast("double")) < float("inf")))
    return usable.withColumns({_US: us, _X: F.col(value).cast("double"), _SLICE: F.floor(us / width)})


def rolling_mean(
    rows: DataFrame,
    keys: Sequence[str],
    seconds: Column | float,
    value: str = "value",
    time: str = "time",
    into: str = "rolling_mean",
    width_seconds: int = DAY,
) -> DataFrame:
    """Mean of the readings of the last `seconds` up to and with each reading,
    the start left out; readings of one instant count for each other.

    A reading is an arrival that adds to a running sum and an expiry that
    takes it off again. Within a slice the sum begins with the halo, so its
    rounding is that of a slice and no series is summed from its start.
    """
    width = width_seconds * 1_000_000
    span = F.floor(_param(seconds) * 1_000_000).cast("long")
    placed = _placed(rows, value, time, width).withColumn("_span", F.when(span > 0, span))
    expires = F.col(_US) + F.col("_span")
    slices = F.sequence(F.col(_SLICE), F.floor((expires - 1) / width))
    spread = placed.withColumn("_at", F.explode(F.coalesce(slices, F.array(_SLICE))))
    start, end = F.col("_at") * width, (F.col("_at") + 1) * width
    known = F.col("_span").isNotNull()
    arrival = F.struct(F.greatest(_US, start).alias("us"), F.lit(1).alias("sign"))
    expiry = F.struct(expires.alias("us"), F.lit(-1).alias("sign"))
    events = spread.withColumn("_e", F.explode(F.when(known & (expires < end), F.array(arrival, expiry)).otherwise(F.array(arrival))))
    # At one moment what expires goes before what arrives counts.
    order = Window.partitionBy(*keys, "_at").orderBy("_e.us", "_e.sign").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = events.withColumns(
        {"_sum": F.sum(F.col(_X) * F.col("_e.sign")).over(order), "_n": F.sum(F.col("_e.sign")).over(order)}
    )
    own = sums.where((F.col("_e.sign") == 1) & (F.col("_at") == F.col(_SLICE)))
    return own.select(*rows.columns, F.when(known, F.col("_sum") / F.col("_n")).alias(into))


def rate_of_change(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    time: str = "time",
    order: Sequence[str] = (),
    into: str = "rate",
    width_seconds: int = DAY,
) -> DataFrame:
    """Change per second since the reading before; null for the first one and
    where both are of one instant. `order` settles that of equal times."""
    placed = _placed(rows, value, time, width_seconds * 1_000_000)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(_US, *order)
    last = placed.groupBy(*keys, _SLICE).agg(F.max_by(F.struct(_US, _X), F.struct(_US, *order)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy(_SLICE))).drop("_last")
    here = placed.withColumn("_prev", F.lag(F.struct(_US, _X)).over(inside))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, _SLICE)]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = here.alias("h").join(before.alias("b"), condition, "left")
    prev = F.coalesce("h._prev", "b._before")
    elapsed = (F.col(f"h.{_US}") - prev[_US]) / 1e6
    rate = F.when(elapsed > 0, (F.col(f"h.{_X}") - prev[_X]) / elapsed)
    return joined.select(*[F.col(f"h.{c}").alias(c) for c in rows.columns], rate.alias(into))


def exponential_smoothing(
    rows: DataFrame,
    keys: Sequence[str],
    alpha: Column | float,
    value: str = "value",
    time: str = "time",
    order: Sequence[str] = (),
    into: str = "smoothed",
    width_seconds: int = DAY,
) -> DataFrame:
    """s = alpha * x + (1 - alpha) * s of the reading before; the first is x.

    Every reading is an affine map of the value before it, and so is a slice:
    s = b + p * s0, which Spark sums up. Per series these maps, one row a
    slice, are applied one after the other, which gives every slice its s0.
    That value goes before the readings of its slice, and the maps of all
    rows of a batch, whatever their slices, are composed in one vectorised scan.
    """
    rate = _param(alpha)
    placed = _placed(rows, value, time, width_seconds * 1_000_000).withColumn("_alpha", F.when((rate > 0) & (rate <= 1), rate))
    group = [*keys, _SLICE]
    from_end = Window.partitionBy(*group).orderBy(F.desc(_US), *[F.desc(c) for c in order])
    numbered = placed.select(*dict.fromkeys([*group, _US, *order, "_alpha", _X])).withColumn("_back", F.row_number().over(from_end))
    fades = F.pow(1 - F.col("_alpha"), F.col("_back") - 1)
    slices = numbered.groupBy(*group).agg(
        F.struct(F.sum(F.col("_alpha") * fades * F.col(_X)).alias("_b"), F.pow(1 - F.max("_alpha"), F.max("_back")).alias("_p")).alias("m"),
        F.max_by(_X, "_back").alias("x"),
    )
    series = slices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(_SLICE).alias("slice"), "m", "x"))).alias("slices"))

    def follow(state: Column, s: Column) -> Column:
        begins = F.coalesce(state["value"], s["x"])  # the first reading smooths to itself
        entered = F.concat(state["entered"], F.array(F.struct(s["slice"].alias("slice"), begins.alias("begins"))))
        return F.struct((s["m"]["_b"] + s["m"]["_p"] * begins).alias("value"), entered.alias("entered"))

    start = F.struct(F.lit(None).cast("double").alias("value"), F.array().cast("array<struct<slice:bigint,begins:double>>").alias("entered"))
    begins = series.select(*keys, F.inline(F.aggregate("slices", start, follow)["entered"])).select(
        *keys, F.col("slice").alias(_SLICE), F.col("begins").alias(_X), F.lit(True).alias("_begins")
    )
    both = placed.withColumn("_begins", F.lit(False)).unionByName(begins, allowMissingColumns=True)
    dealt = both.repartition(*group).sortWithinPartitions(*group, F.desc("_begins"), _US, *order)
    kept = list(rows.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, a = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (_X, "_alpha"))
            opens = batch.column("_begins").to_numpy(zero_copy_only=False).astype(bool)
            known = ~np.isnan(a)
            # A row that opens a slice forgets what was before it.
            b = np.where(opens, x, np.where(known, a * x, 0.0))
            p = np.where(known, 1 - a, 0.0)
            b[0] += p[0] * value
            step = 1
            while step < len(b) and p[step:].any():
                b[step:] += p[step:] * b[:-step]
                p[step:] = p[step:] * p[:-step]
                step *= 2
            value = b[-1]
            out = [batch.column(c) for c in kept] + [pa.array(b, mask=~known)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, into]).filter(pa.array(~opens))

    return dealt.mapInArrow(scan, dealt.select(*kept, F.lit(None).cast("double").alias(into)).schema)
