"""Tables on shared storage: points, archive, alarms, discoveries.

A store is a Parquet folder. Its outer level is the `ingest_batch` of a write,
and a write replaces that folder whole. So a micro-batch that is run again
after a failure leaves what its last run wrote, even if that is less than the
run before, or falls into another hour.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.channels import split_channel
from ..operators.points import dedupe_points
from ..operators.series import in_range, numeric_only
from . import folders

BATCH = "ingest_batch"
# Order in which rows of a batch came in: an offset, or a number given on reading.
ARRIVAL = "arrival"


# Order of points within their files, and what says that a node is not in a row group.
_CLUSTERED = ("mesh_id", "node_id", "field", "time")
_NODE_FILTER = {"parquet.bloom.filter.enabled#node_id": "true", "parquet.bloom.filter.expected.ndv#node_id": "100000"}


def _write_batch(df: DataFrame, path: str, batch: int, partitions: Sequence[str], order: Sequence[str] = ()) -> None:
    # `rebalance` evens out files by partition value and, unlike a hash
    # repartition, lets the engine split a value that holds most of the rows.
    rows = df.hint("rebalance", *partitions) if partitions else df
    if order:
        rows = rows.sortWithinPartitions(*partitions, *order)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .options(**(_NODE_FILTER if "node_id" in order else {}))
        .partitionBy(*partitions)
        .parquet(f"{path}/{BATCH}={batch}")
    )


def write_points(points: DataFrame, path: str, batch: int, settled: bool = False) -> None:
    """S-04, S-07, S-08: store points by day and measurement, in files that are
    sorted by device, field and time: what is read for one device are the few
    pages that hold it (S-06).

    Copies within the batch are folded before the write: the last one to arrive
    stays, by the `arrival` number the rows carry. Rows without it keep the one
    with the highest packet id. Copies from other batches are folded on read or
    by `compact_points`; `settled` points have none.
    """
    carried = ARRIVAL in points.columns
    rows = points if settled else dedupe_points(points, *((ARRIVAL, "packet_id") if carried else ()))
    rows = rows.drop(ARRIVAL)
    rows = rows.withColumn("dt", F.to_date("time"))
    _write_batch(rows, path, batch, ("dt", "measurement"), _CLUSTERED)


def read_points(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    stop: datetime | None = None,
    measurements: Sequence[str] | None = None,
    deduplicate: bool = True,
    visible: Column | None = None,
) -> DataFrame:
    """Points of a time range. Day and measurement prune the folders, as does
    `visible`, the filter of a store whose batches are recorded as whole.

    With `deduplicate` the last write of a point wins; leave it off for days
    that were compacted, where it would only cost a shuffle.
    """
    names = f"{schemas.POINT}, dt date, {BATCH} bigint"
    points = spark.read.schema(names).parquet(path)
    if visible is not None:
        points = points.where(visible)
    if start is not None:
        points = points.where(F.col("dt") >= F.lit(start.date()))
    if stop is not None:
        points = points.where(F.col("dt") <= F.lit(stop.date()))
    if measurements:
        points = points.where(F.col("measurement").isin(*measurements))
    points = in_range(points, start, stop)
    if deduplicate:
        points = dedupe_points(points, BATCH)
    return points.drop("dt", BATCH)


def compact_points(spark: SparkSession, path: str, into: str, day: datetime) -> None:
    """Rewrite one day into another store, each point once."""
    begin = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    folded = read_points(spark, path, begin, begin + timedelta(days=1))
    # A day of the compacted store is a batch of its own, so days don't replace each other.
    _write_batch(folded.withColumn("dt", F.to_date("time")), into, begin.toordinal(), ("dt", "measurement"), _CLUSTERED)


def read_channel(
    points: DataFrame,
    channel: str | Column,
    start: datetime | None = None,
    devices: DataFrame | None = None,
    nodes: Sequence[int] | None = None,
) -> DataFrame:
    """S-06: numeric readings of a channel over a look-back, for many devices.

    The two halves of the channel become two equality predicates, which the
    scan can use; a malformed channel is an error. `nodes` are the few devices
    of an interactive question, which the scan can use too: of files sorted by
    device it reads the pages that hold them. A table of `devices` is joined.
    """
    if nodes is not None:
        points = points.where(F.col("node_id").isin(*nodes))
    if isinstance(channel, str):
        measurement, dot, field = channel.partition(".")
        if not dot or not measurement or not field:
            raise ValueError(f"channel {channel!r} is not <measurement>.<field>")
        points = points.where((F.col("measurement") == measurement) & (F.col("field") == field))
    else:
        parts = split_channel(channel)
        points = points.where(
            (F.col("measurement") == parts["measurement"]) & (F.col("field") == parts["field"])
        )
    readings = numeric_only(in_range(points, start))
    if devices is not None:
        readings = readings.join(
            devices.select("mesh_id", F.col("device_id").alias("node_id")), ["mesh_id", "node_id"], "left_semi"
        )
    return readings


_ARCHIVE_FOLDERS = ("mesh_id", "node_id", "dt", "hour")


def write_archive(rows: DataFrame, path: str, batch: int, written_at: Column | None = None) -> None:
    """S-05: events by mesh, node and hour of *writing*.

    An empty batch writes nothing. A missing mesh or node goes to the engine's
    default partition. A folder a node is what takes time, so on a mounted file
    system the tasks make them without the engine's committer.
    """
    now = written_at if written_at is not None else F.current_timestamp()
    stamped = rows.withColumn("dt", F.date_format(now, "yyyy-MM-dd")).withColumn(
        "hour", F.date_format(now, "HH")
    )
    at = folders.mounted(rows.sparkSession, f"{path}/{BATCH}={batch}")
    if at is None:
        _write_batch(stamped, path, batch, _ARCHIVE_FOLDERS)
    else:
        folders.write_folders(stamped, at, _ARCHIVE_FOLDERS)


def read_archive(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """S-05: the archive, all of it or some columns of its files beside those of
    its folders. Types are stated: where the engine guesses at them, a mesh `007`
    becomes 7."""
    schema = StructType.fromDDL(schemas.ARCHIVE)
    levels = (BATCH, *_ARCHIVE_FOLDERS)
    if columns:
        schema = StructType([f for f in schema if f.name in (*columns, *levels)])
    at = folders.mounted(spark, path)
    if at is None:
        return spark.read.schema(schema).parquet(path)
    return folders.read_folders(spark, at, schema, levels)


def write_rows(rows: DataFrame, path: str, batch: int, by: Sequence[str] = ()) -> None:
    """S-09 and the registry side: any table of events, one write per batch."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*by)
        .parquet(f"{path}/{BATCH}={batch}")
    )
