"""Packets to stored tables, one micro-batch at a time (S-10, T-01, T-05)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changelog, packets, points
from ..operators.calibrate import calibrate_events
from ..sources import store
from ..sources.commits import Commits
from ..sources.levels import LevelTable
from . import runtime

# Returns the registered gateways and the rejected nodes as of now.
ConfigLoader = Callable[[SparkSession], tuple[DataFrame, DataFrame]]
# Returns the changes of a feed beyond an offset; all of them for None.
ChangesSince = Callable[[SparkSession, int | None], DataFrame]


def config_from_changes(read_changes: Callable[[SparkSession], DataFrame], version: str = "version") -> ConfigLoader:
    """Configuration folded from its changelog, read anew for every batch.

    Reading it before the packets of the batch are joined means that a packet
    never meets a registry older than its own batch.
    """

    def load(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        changes = read_changes(spark)
        return changelog.gateways_of(changes, (version,)), changelog.rejections_of(changes, (version,))

    return load


@dataclass(frozen=True)
class LiveTable:
    """T-01, S-02: a changelog that a stream follows, as a table of its latest
    versions. Each micro-batch takes in what has been appended since the last
    one and no more, before its packets are joined; a batch that is run again
    after a failure is given the configuration it had."""

    table: LevelTable
    read_since: ChangesSince

    def as_of_batch(self, spark: SparkSession, batch: int) -> DataFrame:
        return self.table.read(spark, self.table.catch_up(spark, self.read_since, batch))

    def gates(self, spark: SparkSession, batch: int) -> tuple[DataFrame, DataFrame]:
        """A merged feed (`CONFIG_CHANGE`) as registered gateways and rejected nodes."""
        # Live rows have one version per key, so folding them again is not needed.
        rows = self.as_of_batch(spark, batch)
        return (
            rows.where(F.col("kind") == "gateway_key").select(F.col("key").alias("gateway_id"), "mesh_id"),
            rows.where(F.col("kind") == "node_rejection").select("mesh_id", "device_id"),
        )


def config_table(path: str) -> LevelTable:
    """Where the merged gateway and rejection feed is kept."""
    from .. import schemas

    return LevelTable(path, schemas.CONFIG_CHANGE, ("kind", "key"))


@dataclass(frozen=True)
class IngestPaths:
    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("decoded", "points", "sightings", "discoveries", "drops", "unreadable", "dead_letters"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def kinds_of(gated: DataFrame) -> dict[str, DataFrame]:
    """U-04: the events one gated batch gives rise to, by kind."""
    events = packets.decoded(gated)
    return {
        "decoded": events,
        "sightings": packets.sightings(events),
        "discoveries": packets.discoveries(events),
        "drops": packets.drop_messages(gated),
    }


def kind_counts(gated: DataFrame) -> DataFrame:
    """U-04: rows of each kind, counted in one pass."""
    kept = F.col("drop_reason").isNull()
    named = gated.withColumn("payload_kind", packets.payload_kind(F.col("portnum"), F.col("variant")))
    telemetry = kept & packets.of_known_mesh() & F.col("payload_kind").startswith("telemetry:")
    payload = F.when(telemetry, F.try_parse_json("payload"))
    flags = {
        "decoded": kept,
        "sightings": kept & packets.of_known_mesh(),
        "discoveries": F.coalesce(telemetry & (F.size(packets.own_fields()) > 0), F.lit(False)),
        "drops": ~kept,
    }
    sums = named.withColumn("_payload", payload).agg(*[F.count_if(flag).alias(kind) for kind, flag in flags.items()])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("events")) for kind in flags])
    return sums.select(F.inline(rows))


def write_ingest(
    envelopes: DataFrame,
    batch: int,
    gateways: DataFrame,
    rejections: DataFrame,
    paths: IngestPaths,
    calibrations: DataFrame | None = None,
    on_written: Callable[[str, int], None] | None = None,
) -> None:
    """S-10, T-04: gate a batch once, then write each kind to its own table.

    The batch is recorded when all of its tables are written, so readers of the
    record see them appear together (`read_table`); a batch that is recorded is
    not written again. `on_written` is told of each table.

    Of two copies of a point the one that arrived last stays. A source with
    offsets hands them on as `arrival`; else rows are numbered as they are read.
    """
    if store.ARRIVAL not in envelopes.columns:
        envelopes = envelopes.withColumn(store.ARRIVAL, F.monotonically_increasing_id())
    spark, commits = envelopes.sparkSession, Commits(paths.root)
    if commits.holds(spark, batch):
        return
    gated = runtime.spread(packets.gate(envelopes, gateways, rejections)).persist()
    try:
        kinds = kinds_of(gated)
        # Points store what was decoded; calibrated events are a table apart.
        arrived = packets.decoded(gated, store.ARRIVAL)
        writes: dict[str, Callable[[], None]] = {
            "decoded": lambda: store.write_rows(kinds["decoded"], paths.decoded, batch),
            "points": lambda: store.write_points(points.event_points(arrived), paths.points, batch),
            "sightings": lambda: store.write_rows(kinds["sightings"], paths.sightings, batch),
            "discoveries": lambda: store.write_rows(kinds["discoveries"], paths.discoveries, batch),
            "drops": lambda: store.write_rows(kinds["drops"], paths.drops, batch),
            "unreadable": lambda: store.write_rows(unreadable(kinds["decoded"]), paths.unreadable, batch),
        }
        if calibrations is not None:
            calibrated = calibrate_events(kinds["decoded"], calibrations)
            writes["calibrated"] = lambda: store.write_rows(calibrated, f"{paths.root}/calibrated", batch)
        for name, write in writes.items():
            write()
            if on_written:
                on_written(name, batch)
        commits.commit(spark, batch)
    finally:
        gated.unpersist()


def unreadable(events: DataFrame) -> DataFrame:
    """T-09: decoded packets whose payload the parser refuses, as one that nests
    over a thousand levels. They are archived as they are and have no points."""
    refused = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    return events.where(refused).withColumn("reject_reason", F.lit("unreadable_payload"))


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the ingest as its record shows it: whole batches only."""
    return Commits(root).read(spark, name, schema)


def start_ingest(
    envelopes: DataFrame,
    load_config: ConfigLoader | LiveTable,
    root: str,
    checkpoint: str,
    every_seconds: int | None = None,
    load_calibrations: Callable[[SparkSession], DataFrame] | LiveTable | None = None,
    on_written: Callable[[str, int], None] | None = None,
) -> StreamingQuery:
    """T-01, J-03: packets joined with the latest configuration and, where
    curves are given, a table of calibrated events beside the decoded ones.
    Configuration that comes as a `LiveTable` is kept up with, not read anew.

    Records that `parse_events` marked go to the dead letters of the batch.
    """
    paths = IngestPaths(root)
    marked = "reject_reason" in envelopes.columns

    def write(batch: DataFrame, number: int) -> None:
        if marked:
            dead_letter_writer(paths.dead_letters)(batch, number)
            batch = batch.where(F.col("reject_reason").isNull()).drop("raw", "reject_reason")
        spark = batch.sparkSession
        live = isinstance(load_config, LiveTable)
        gateways, rejections = load_config.gates(spark, number) if live else load_config(spark)
        curves = None
        if load_calibrations:
            live = isinstance(load_calibrations, LiveTable)
            curves = load_calibrations.as_of_batch(spark, number) if live else load_calibrations(spark)
        write_ingest(batch, number, gateways, rejections, paths, curves, on_written)

    return runtime.start(envelopes, write, checkpoint, every_seconds)


def start_archive(
    events: DataFrame,
    path: str,
    checkpoint: str,
    every_seconds: int | None = runtime.FLUSH_SECONDS,
    written_at: Column | None = None,
) -> StreamingQuery:
    """T-05: archive decoded events; the size limit is set on the source."""

    def write(batch: DataFrame, number: int) -> None:
        store.write_archive(packets.archive_rows(batch), path, number, written_at)

    return runtime.start(events, write, checkpoint, every_seconds)


def start_point_writer(
    feed: DataFrame, path: str, checkpoint: str, every_seconds: int | None = 1
) -> StreamingQuery:
    """S-04, U-02: decoded events and alarms from one feed into the points."""

    def write(batch: DataFrame, number: int) -> None:
        store.write_points(points.all_points(batch), path, number)

    return runtime.start(feed, write, checkpoint, every_seconds)


def start_settled_point_writer(
    events: DataFrame, path: str, checkpoint: str, every_seconds: int | None = 1, late_seconds: int = 3_600
) -> StreamingQuery:
    """S-04, T-03: points of decoded events, each stored once over all
    micro-batches, so the store is read without folding.

    A point waits in state until the watermark is past its time; of its copies
    until then, in whatever batch, the last to arrive is the one stored
    (`arrival`, a column of the events). State is bounded by `late_seconds`
    of points. Copies that come later are dropped and counted by the engine.
    """
    waiting = points.event_points(runtime.spread(events)).withWatermark("time", f"{late_seconds} seconds")
    final = points.dedupe_points(waiting, store.ARRIVAL, "packet_id").drop(store.ARRIVAL)
    return runtime.start(final, lambda batch, number: store.write_points(batch, path, number, settled=True), checkpoint, every_seconds)


def dead_letter_writer(path: str) -> Callable[[DataFrame, int], None]:
    """T-09: rejected records, with the reason, kept once per batch."""

    def write(batch: DataFrame, number: int) -> None:
        rejected = batch.where(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")
        store.write_rows(rejected, path, number)

    return write
