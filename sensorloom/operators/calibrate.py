"""Calibration of every number in a payload, in place (J-03, C-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calibration as C, jsonvalues as J
from ..functions.deep import deep_calibrated
from .changelog import latest_per_key


def curves_by_series(changes: DataFrame) -> DataFrame:
    """Live calibrations as one row per `channel:node:payload_kind`, with a map
    from field name to curve.

    A map has at most as many entries as a payload kind has fields. With it a
    packet needs one lookup, and its payload is never taken apart and regrouped.
    """
    live = C.parse_params(latest_per_key(changes))
    field = F.substring_index("key", ":", -1)
    return (
        live.where(F.instr("key", ":") > 0)
        .select(
            F.expr("substring(key, 1, length(key) - length(substring_index(key, ':', -1)) - 1)").alias(
                "_series"
            ),
            field.alias("_field"),
            "curve",
        )
        .groupBy("_series")
        .agg(F.map_from_entries(F.collect_list(F.struct("_field", "curve"))).alias("_curves"))
    )


def series_key() -> Column:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.concat_ws(":", text("channel_id"), text("node_id"), text("payload_kind"))


def _calibrated(members: Column, curves: Column, depth: int) -> Column:
    def member(key: Column, value: Column) -> Column:
        curve = F.try_element_at(curves, key)
        number = F.when(
            J.is_number(value) & curve.isNotNull(),
            C.apply_curve(J.number(value), curve).cast("variant"),
        )
        if depth > 1:
            inner = _calibrated(J.as_object(value), curves, depth - 1)
            nested = F.when(J.is_object(value), F.to_variant_object(inner))
        else:
            nested = F.lit(None).cast("variant")
        return F.coalesce(number, nested, value)

    return F.transform_values(members, member)


def calibrate_events(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events with calibrated payloads; packets without a curve pass untouched."""
    curves = curves_by_series(changes)
    members = J.as_object(F.try_parse_json("payload"))
    rebuilt = F.to_json(_calibrated(members, F.col("_curves"), J.UNROLLED))
    # What the expression leaves as it was below its last level, `deep` rewrites.
    # A text with no more braces than levels needs no look at its levels.
    braces = F.length("payload") - F.length(F.replace("payload", F.lit("{"), F.lit("")))
    deeper = F.when(braces > J.UNROLLED, _has_level(members, J.UNROLLED)).otherwise(F.lit(False))
    found = events.withColumn("_series", series_key()).join(curves, "_series", "left")
    far = F.when(F.col("_curves").isNotNull() & deeper, F.col("payload"))
    found = found.withColumn("_far", far)
    # Curves go to the few rows that need them there.
    found = found.withColumn("_far", deep_calibrated("_far", F.when(F.col("_far").isNotNull(), F.col("_curves"))))
    return found.withColumn(
        "payload", F.when(F.col("_curves").isNotNull(), F.coalesce("_far", rebuilt, "payload")).otherwise(F.col("payload"))
    ).select(*events.columns)


def _has_level(members: Column, below: int) -> Column:
    """Whether objects nest over `below` levels deep."""
    if below == 0:
        return F.lit(True)
    inner = lambda value: _has_level(J.as_object(value), below - 1)
    return F.exists(F.map_values(members), lambda value: J.is_object(value) & inner(value))
