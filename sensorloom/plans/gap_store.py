"""Completeness from stored summaries (A-05, R-06): a scan reads what is new.

Readings of a series within an hour are summarised to a number, the first and
last moment and the largest gap between. Such summaries merge: numbers add up,
gaps between one's last and the next one's first join the others. They are
kept by hour, so a scan summarises the hours that have passed since the last
one, and merges those of its look-back instead of reading all its points.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bounds import duration_seconds
from ..operators import quality as Q
from ..operators.series import numeric_only
from ..operators.sliced import SLICE, gap_slices, merge_gap_slices
from ..sources.commits import Commits
from ..sources.store import BATCH
from . import quality_scan

HOUR = 3_600
_SCHEMA = f"mesh_id string, node_id bigint, channel string, {SLICE} bigint, _n bigint, _first bigint, _last bigint, _inner bigint"

# Points from a moment on and before another one; a store prunes by both.
ReadPoints = Callable[[SparkSession, datetime, datetime], DataFrame]


class GapStore:
    """One writer. An hour is summarised once it has ended `settle_seconds` ago;
    points that come later than that are not in its summary until `forget`
    has the hour read again."""

    def __init__(self, root: str, read_points: ReadPoints, width_seconds: int = HOUR, settle_seconds: int = 0):
        self.root, self.read_points, self.width, self.settle = root, read_points, width_seconds, settle_seconds
        self.commits = Commits(root)
        self.forgotten: set[int] = set()

    def _moment(self, number: int) -> datetime:
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=number * self.width)

    def _summaries(self, spark: SparkSession, start: datetime, stop: datetime) -> DataFrame:
        points = self.read_points(spark, start, stop).where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(stop)))
        return gap_slices(numeric_only(points), Q.CHANNEL, width_seconds=self.width)

    def forget(self, *slices: int) -> None:
        """Have these slices read again by the next scan."""
        self.forgotten.update(slices)

    def refresh(self, spark: SparkSession, first: int, end: int) -> list[int]:
        """Summarise the slices from `first` and before `end` that are not stored; returns them."""
        ranges = self.commits.ranges(spark)
        held = lambda n: any(low <= n <= high for low, high in ranges)
        missing = [n for n in range(first, end) if n in self.forgotten or not held(n)]
        if missing:
            rows = self._summaries(spark, self._moment(missing[0]), self._moment(missing[-1] + 1)).where(F.col(SLICE).isin(*missing))
            (
                rows.withColumn(BATCH, F.col(SLICE)).repartition(BATCH).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{self.root}/slices")
            )
            self.commits.commit(spark, *missing)
            self.forgotten.difference_update(missing)
        return missing

    def stats(self, spark: SparkSession, start: datetime, stop: datetime) -> DataFrame:
        """Summary of every channel over [start, stop). Whole slices come from the
        store; what lies before the first and behind the last one is read."""
        us = lambda moment: (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        wide = self.width * 1_000_000
        first, end = -(-us(start) // wide), (us(stop) - self.settle * 1_000_000) // wide
        if first >= end:
            return merge_gap_slices(self._summaries(spark, start, stop), Q.CHANNEL)
        self.refresh(spark, first, end)
        parts = self.commits.read(spark, "slices", _SCHEMA).where(F.col(BATCH).between(first, end - 1)).drop(BATCH)
        for low, high in ((start, self._moment(first)), (self._moment(end), stop)):
            if low < high:
                parts = parts.unionByName(self._summaries(spark, low, high))
        return merge_gap_slices(parts, Q.CHANNEL)


def check_completeness(
    spark: SparkSession,
    gaps: GapStore,
    channels: DataFrame,
    devices: DataFrame,
    variants: DataFrame,
    as_of: datetime,
    lookback: str = quality_scan.COMPLETENESS_LOOKBACK,
) -> quality_scan.CompletenessRun:
    """R-06 as `quality_scan.check_completeness`, from the store of summaries."""
    seconds = duration_seconds(lookback)
    stats = gaps.stats(spark, as_of - timedelta(seconds=seconds), as_of)
    expected = quality_scan.channel_intervals(channels, devices, variants)
    return quality_scan.results_of(Q.completeness_of(expected, stats, seconds), lookback, as_of)
