"""The scheduled quality scan as set-based jobs over all devices."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.bounds import duration_seconds, resolve_bound
from ..operators import blueprints as B, quality as Q, recipes as R
from ..operators.registry import scan_summary
from ..operators.series import in_range, numeric_only

COMPLETENESS_LOOKBACK = "-24h"
BLUEPRINT_LOOKBACK = "-7d"


@dataclass
class CompletenessRun:
    stats: DataFrame
    alarms: DataFrame
    points: DataFrame
    discoveries: DataFrame


def channel_intervals(channels: DataFrame, devices: DataFrame, variants: DataFrame) -> DataFrame:
    """Measured channels of registered devices with their reading interval."""
    return (
        channels.where(F.col("origin") == "measured")
        .join(devices.select("mesh_id", "device_id", "reading_interval_seconds"), ["mesh_id", "device_id"])
        .join(variants.select("payload_kind", "default_reading_interval_seconds"), "payload_kind", "left")
        .select(
            "mesh_id",
            F.col("device_id").alias("node_id"),
            "channel",
            Q.reading_interval(
                F.col("reading_interval_seconds"), F.col("default_reading_interval_seconds")
            ).alias("interval_seconds"),
        )
    )


def check_completeness(
    points: DataFrame,
    channels: DataFrame,
    devices: DataFrame,
    variants: DataFrame,
    as_of: datetime,
    lookback: str = COMPLETENESS_LOOKBACK,
) -> CompletenessRun:
    """R-06: completeness of every measured channel of every device."""
    readings = numeric_only(in_range(points, resolve_bound(lookback, as_of, "lookback")))
    expected = channel_intervals(channels, devices, variants)
    return results_of(Q.completeness(expected, readings, duration_seconds(lookback)), lookback, as_of)


def results_of(stats: DataFrame, lookback: str, as_of: datetime) -> CompletenessRun:
    return CompletenessRun(
        stats,
        Q.completeness_alarms(stats, lookback, as_of),
        Q.quality_points(stats, as_of),
        Q.quality_discoveries(stats, as_of),
    )


@dataclass
class BlueprintRun:
    blueprint_id: str
    units: dict[str, str | None]
    derived: DataFrame
    points: DataFrame
    discoveries: DataFrame
    failures: DataFrame


def run_blueprint(
    blueprint_id: str,
    steps: DataFrame,
    devices: DataFrame,
    points: DataFrame,
    types: DataFrame | None,
    as_of: datetime,
    lookback: str = BLUEPRINT_LOOKBACK,
) -> BlueprintRun:
    """B-04: one job for all devices that use a blueprint."""
    recipe = B.load_steps(steps, blueprint_id)
    members = devices.where(F.col("postprocessing_blueprint_id") == blueprint_id)
    readings = numeric_only(in_range(points, resolve_bound(lookback, as_of, "lookback")))
    known = catalog_units(types, recipe) if types is not None else {}
    run = B.run_steps(recipe, B.align_for(recipe, readings, members), known)
    derived = B.derived_rows(run, blueprint_id)
    seen = F.lit(as_of).cast("timestamp")
    return BlueprintRun(
        blueprint_id, run.units, derived, B.derived_points(derived), B.derived_discoveries(derived, run.units, seen), B.failure_counts(run)
    )


@dataclass
class FleetRun:
    bound: DataFrame
    derived: DataFrame
    points: DataFrame
    failures: DataFrame


def run_blueprints(
    steps: DataFrame,
    devices: DataFrame,
    points: DataFrame,
    types: DataFrame | None,
    as_of: datetime,
    lookback: str = BLUEPRINT_LOOKBACK,
) -> FleetRun:
    """B-04: one job for all devices and all their blueprints, windowed steps
    included. The plan has one scan of the points and does not grow with the
    number of blueprints."""
    members = devices.where(F.coalesce("postprocessing_blueprint_id", F.lit("")) != "")
    used = members.select(F.col("postprocessing_blueprint_id").alias("blueprint_id")).distinct()
    hints = R.joined_by(steps)
    own = steps.join(R.hinted(used, hints), "blueprint_id", "left_semi")
    readings = numeric_only(in_range(points, resolve_bound(lookback, as_of, "lookback")))
    bound = R.bound_steps(own, types, hints)
    run = R.run_recipes(R.aligned_cells(readings, members, own, hints=hints), R.recipes_of(bound), hints=hints)
    derived = R.derived_rows(run)
    return FleetRun(bound, derived, B.derived_points(derived), R.failure_counts(run))


def catalog_units(types: DataFrame, recipe: list[B.Step]) -> dict[str, str | None]:
    """Units of the channels a recipe reads. At most one row per channel of the
    recipe reaches the driver."""
    from ..functions.channels import channel_name

    wanted = B.required_channels(recipe)
    rows = (
        types.select(channel_name(F.col("payload_kind"), F.col("field_name")).alias("channel"), "native_unit")
        .where(F.col("channel").isin(*wanted))
        .groupBy("channel")
        .agg(F.max("native_unit").alias("unit"))
        .collect()
    )
    return {r["channel"]: r["unit"] for r in rows}


def scan(devices: DataFrame) -> DataFrame:
    return scan_summary(devices)
