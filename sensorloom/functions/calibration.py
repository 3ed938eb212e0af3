"""Calibration curves as Column expressions. None of them raises: whatever
cannot be computed leaves the reading as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import jsonvalues as J

IDENTITY, OFFSET_SCALE, LOOKUP_TABLE = "identity", "offset_scale", "lookup_table"


def parse_params(config: DataFrame, params: str = "params") -> DataFrame:
    """Add a typed `curve` to calibration rows, read once per row and not per
    reading: struct<function_name, scale, offset, points>.

    A missing scale or offset gets its default; one of a wrong type is null
    and disables the curve, as does a malformed or empty point list.
    """
    parsed = F.coalesce(F.try_parse_json(params), F.parse_json(F.lit("{}")))

    def factor(name: str, default: float) -> Column:
        given = F.try_variant_get(F.col("_params"), f"$.{name}", "variant")
        return F.when(given.isNull(), F.lit(default)).otherwise(J.number(given))

    listed = F.try_variant_get(F.col("_params"), "$.points", "array<variant>")
    pairs = F.transform(listed, lambda p: F.try_variant_get(p, "$", "array<variant>"))
    points = F.transform(
        pairs,
        lambda p: F.struct(
            J.coerced_double(F.get(p, F.lit(0))).alias("x"),
            J.coerced_double(F.get(p, F.lit(1))).alias("y"),
        ),
    )
    well_formed = (
        (F.size(listed) > 0)
        & F.forall(pairs, lambda p: p.isNotNull() & (F.size(p) == 2))
        & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    )
    return (
        config.withColumn("_params", parsed)
        .withColumn(
            "curve",
            F.struct(
                F.coalesce("function_name", F.lit(IDENTITY)).alias("function_name"),
                factor("scale", 1.0).alias("scale"),
                factor("offset", 0.0).alias("offset"),
                F.when(well_formed, F.array_sort(points)).alias("points"),
            ),
        )
        .drop("_params")
    )


def interpolate(value: Column, points: Column) -> Column:
    """C-03: piecewise linear through sorted points, constant outside them.

    At an x that occurs twice inside the table the lower y counts; at the
    upper end the higher one.
    """
    head, tail = F.get(points, F.lit(0)), F.element_at(points, -1)
    # First point at or right of the value; its left neighbour opens the segment.
    right = F.array_position(F.transform(points, lambda p: p["x"] >= value), True).cast("int")
    low, high = F.get(points, right - 2), F.get(points, right - 1)
    ratio = (value - low["x"]) / F.nullif(high["x"] - low["x"], F.lit(0.0))
    return (
        F.when(value <= head["x"], head["y"])
        .when(value >= tail["x"], tail["y"])
        .otherwise(low["y"] + ratio * (high["y"] - low["y"]))
    )


def apply_curve(value: Column, curve: Column) -> Column:
    """C-01 to C-04: calibrated value, or the value itself."""
    result = F.when(
        curve["function_name"] == OFFSET_SCALE, value * curve["scale"] + curve["offset"]
    ).when(
        curve["function_name"] == LOOKUP_TABLE,
        F.when(F.size(curve["points"]) == 1, F.get(curve["points"], F.lit(0))["y"]).otherwise(
            interpolate(value, curve["points"])
        ),
    )
    return F.coalesce(result, value)
