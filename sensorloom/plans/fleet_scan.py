"""The scheduled scan of the whole fleet, written to stores."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import recipes
from ..operators.points import dedupe_points
from ..operators.quality import CHANNEL, quality_points
from ..sources import store
from . import quality_scan


@dataclass(frozen=True)
class ScanPaths:
    root: str

    @property
    def points(self) -> str:
        return f"{self.root}/points"

    @property
    def alarms(self) -> str:
        return f"{self.root}/alarms"

    @property
    def discoveries(self) -> str:
        return f"{self.root}/discoveries"

    @property
    def stats(self) -> str:
        return f"{self.root}/completeness"


def scan_fleet(
    points: DataFrame,
    channels: DataFrame,
    devices: DataFrame,
    variants: DataFrame,
    steps: DataFrame,
    types: DataFrame | None,
    root: str,
    batch: int,
    as_of: datetime,
    completeness_lookback: str = quality_scan.COMPLETENESS_LOOKBACK,
    blueprint_lookback: str = quality_scan.BLUEPRINT_LOOKBACK,
) -> ScanPaths:
    """R-06, B-04: completeness of every channel and every blueprint in use.

    Blueprints are data: the points are aligned and folded once, whatever the
    number of recipes. Derived and quality points go to the point store in one
    write, alarms and discoveries to theirs. Copies are folded before: derived
    points by their key, quality points where a channel still is one row of
    numbers and not four points. Statistics are written first and read back,
    so they are computed once. A scan that is run again under its number
    replaces what it wrote.
    """
    spark, paths = points.sparkSession, ScanPaths(root)
    run = quality_scan.check_completeness(points, channels, devices, variants, as_of, completeness_lookback)
    store.write_rows(run.stats, paths.stats, batch)
    stats = spark.read.schema(run.stats.schema).parquet(f"{paths.stats}/{store.BATCH}={batch}")
    quality = quality_scan.results_of(stats, completeness_lookback, as_of)
    store.write_rows(quality.alarms, paths.alarms, batch)
    run = quality_scan.run_blueprints(steps, devices, points, types, as_of, blueprint_lookback)
    join = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    figures = quality_points(stats.dropDuplicates(list(CHANNEL)), as_of)
    derived = dedupe_points(run.points, store.ARRIVAL, "packet_id")
    store.write_points(join([figures, derived]), paths.points, batch, settled=True)
    # What was derived is read from the store, so blueprints are not run twice.
    written = spark.read.parquet(f"{paths.points}/{store.BATCH}={batch}").where(F.col("measurement") == "derived")
    named = written.withColumn("blueprint_id", F.col("tags")["blueprint_id"])
    found = recipes.derived_discoveries(named, run.bound, F.lit(as_of).cast("timestamp"))
    store.write_rows(join([quality.discoveries, found]), paths.discoveries, batch)
    return paths
