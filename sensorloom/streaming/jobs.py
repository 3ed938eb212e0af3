"""Jobs a user starts: detection and notification over live streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import detect, packets
from ..operators.cooldown import COOLDOWN_SECONDS, cool_down
from ..operators.detect import FLAT_DEFAULT
from ..operators.registry import route_alarms
from ..sources import store
from ..sources.levels import LevelTable
from . import runtime
from .ingest import LiveTable

Loader = Callable[[SparkSession], DataFrame]


def rule_table(path: str) -> LevelTable:
    """Where the changelog of range rules is kept."""
    return LevelTable(path, schemas.RULE_CHANGE)


def start_detection(
    events: DataFrame,
    load_rules: Loader | LiveTable,
    root: str,
    every_seconds: int | None = None,
    window: int = FLAT_DEFAULT,
    partitions: int | None = None,
) -> list[StreamingQuery]:
    """R-01, R-02, J-04: stuck values and range rules over decoded or
    calibrated events.

    Two queries read the events. Runs of equal values are found in Spark within
    a micro-batch, in time slices, together with the last readings of each
    series before it, which are kept as a table of levels: state has one row a
    series, and no reading passes through Python. Rules are looked up for
    each micro-batch, so a changed rule holds for all packets that come after
    it. Rules that come as a `LiveTable` are kept up with; a loader's are read
    anew. Alarms are under `root`/stuck_value and `root`/range_check.
    """
    last = recent_table(f"{root}/stuck_value-state")

    def write_stuck(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = last.version(spark)
        done = dict(now.marks).get(number)
        before = now if done is None else last.version(spark, done - 1) if done > 1 else None
        # Payloads are parsed once: the readings are asked for series, runs and the last ones of each series.
        fresh = packets.observations(runtime.spread(batch), include_time=False).where(F.col("value").isNotNull() & ~F.isnan("value"))
        fresh = fresh.withColumn("is_new", F.lit(True)).persist()
        try:
            # Filled by one job; else all that read it ask for it at once, and their tasks wait for each other.
            fresh.count()
            readings = fresh
            if before and before.segments:
                readings = readings.unionByName(_recent(last.read(spark, before), readings))
            flat = detect.flat_readings(readings, SERIES, window).where("is_new")
            store.write_rows(detect.stuck_alarms(flat, window), f"{root}/stuck_value", number)
            if done is None:
                # A limit per key is applied before the shuffle too, so a busy series is reduced where it is read.
                newest = Window.partitionBy(*SERIES).orderBy(F.desc("time"), F.desc("packet_id"))
                kept = readings.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") < window)
                rows = kept.groupBy(*SERIES).agg(F.collect_list(F.struct("time", "packet_id", "value")).alias("recent"), F.max(F.unix_micros("time")).alias("version"))
                last.append(rows.withColumn("op", F.lit("upsert")), number)
        finally:
            fresh.unpersist()

    def write_ranges(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rules = load_rules.as_of_batch(spark, number) if isinstance(load_rules, LiveTable) else load_rules(spark)
        store.write_rows(detect.range_check(packets.observations(runtime.spread(batch), include_time=False), rules), f"{root}/range_check", number)

    return [
        runtime.start(events, write_stuck, f"{root}/_checkpoints/stuck_value", every_seconds, partitions=partitions),
        runtime.start(events, write_ranges, f"{root}/_checkpoints/range_check", every_seconds, partitions=partitions),
    ]


SERIES = ("node_id", "mesh_id", "field")


def recent_table(path: str) -> LevelTable:
    """The last readings of each series, as many as a run may still need."""
    schema = "node_id bigint, mesh_id string, field string, recent array<struct<time:timestamp,packet_id:bigint,value:double>>, op string, version bigint"
    return LevelTable(path, schema, SERIES)


def _recent(state: DataFrame, readings: DataFrame) -> DataFrame:
    """Stored readings of the series that a batch has readings of."""
    here = readings.select(*SERIES).distinct().alias("h")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in SERIES]
    known = state.alias("s").join(here, same, "left_semi").select(*SERIES, F.inline("recent"))
    return known.select(*[F.col(c) for c in readings.columns if c != "is_new"], F.lit(False).alias("is_new"))


def start_notifications(
    alarms: DataFrame,
    load_registry: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    every_seconds: int | None = None,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    partitions: int | None = None,
) -> StreamingQuery:
    """T-07, J-10, T-06: routing, then cool-down, of a stream of alarms. Open the
    stream at the latest offset, so that a new job sends no old alarms.

    The registry is looked up for each micro-batch: it decides whether anyone
    would get an alarm, and so whether it starts a cool-down. When an alarm of a
    key was last sent is kept as a table of levels beside the notifications,
    with one row per key; a batch's alarms are reduced in Spark before it is
    read. A batch that is run again begins with what its first run began with.
    """
    last_sent = sent_table(f"{path}-state")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        registry = load_registry(spark)
        heard = batch.where(F.coalesce("detector", F.lit("")) != "").join(reached(*registry), ["mesh_id", "device_id"], "left_semi")
        now = last_sent.version(spark)
        done = dict(now.marks).get(number)
        before = now if done is None else last_sent.version(spark, done - 1) if done > 1 else None
        state = last_sent.read(spark, before) if before and before.segments else None
        sent = cool_down(heard.select(*alarms.columns), cooldown_seconds=cooldown_seconds, last_sent=state)
        store.write_rows(route_alarms(sent, *registry), path, number)
        if done is None:
            moments = sent.groupBy("mesh_id", "device_id", "channel", "detector").agg(F.max("triggered_at").alias("sent_at"))
            # In the order of the clock or not: the newest moment of a key is its latest version.
            last_sent.append(moments.withColumns({"op": F.lit("upsert"), "version": F.unix_micros("sent_at")}), number)

    return runtime.start(alarms, write, checkpoint, every_seconds, partitions=partitions)


def sent_table(path: str) -> LevelTable:
    """When an alarm of each key was last sent."""
    schema = "mesh_id string, device_id bigint, channel string, detector string, sent_at timestamp, op string, version bigint"
    return LevelTable(path, schema, ("mesh_id", "device_id", "channel", "detector"))


def reached(devices: DataFrame, meshes: DataFrame, owners: DataFrame) -> DataFrame:
    """Devices whose alarms reach somebody."""
    active = owners.where(F.col("is_active") & (F.coalesce("email", F.lit("")) != "")).select("owner_id")
    return (
        devices.select("mesh_id", "device_id")
        .join(meshes.select("mesh_id", "owner_id"), "mesh_id")
        .join(active, "owner_id", "left_semi")
        .select("mesh_id", "device_id")
        .distinct()
    )
