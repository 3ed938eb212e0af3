"""Keyed streaming state: stuck values, cool-down and absence.

Each processor keeps a few numbers per key. The rows of a key within one
micro-batch are put in time order first; their number is bounded by the
size limit of the source (`maxOffsetsPerTrigger`, `maxFilesPerTrigger`).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cooldown import COOLDOWN_SECONDS
from ..operators.detect import FLAT_DEFAULT, SILENT_INTERVALS, STUCK_TEXT

_ALARM = T.StructType(
    [
        T.StructField("mesh_id", T.StringType()),
        T.StructField("device_id", T.LongType()),
        T.StructField("channel", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("triggered_at", T.TimestampType()),
    ]
)


def _micros(moment: datetime) -> int:
    delta = moment.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


class StuckValue(StatefulProcessor):
    """T-02: value and length of the current run of equal values."""

    def __init__(self, window: int = FLAT_DEFAULT):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "value double, length bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value, length = self.run.get() if self.run.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: (r["time"], r["packet_id"])):
            length = length + 1 if row["value"] == value else 1
            value = row["value"]
            if length >= self.window:
                yield Row(
                    mesh_id=key[0],
                    device_id=key[1],
                    channel=key[2],
                    detector="stuck_value",
                    source="stream",
                    value=value,
                    message=STUCK_TEXT % (value, self.window),
                    triggered_at=row["time"],
                )
        self.run.update((value, length))

    def close(self) -> None:
        pass


class CoolDown(StatefulProcessor):
    """T-06: time of the last alarm that was let through."""

    def __init__(self, cooldown_seconds: int = COOLDOWN_SECONDS):
        self.cooldown = cooldown_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sent bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: (r["triggered_at"], r["message"] or "")):
            now = _micros(row["triggered_at"])
            if last is None or now >= last + self.cooldown:
                last = now
                yield row
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


class OrderedRuns(StatefulProcessor):
    """T-02, T-03: runs of equal values over readings that come in any order.

    Readings wait in a buffer by time until the watermark says that no earlier
    one is to be expected, and are then taken in order; a timer at the earliest
    waiting reading brings that about. The query's watermark is later than
    that by a grace, so that a reading which comes too late is still seen, and
    is given out as late.
    """

    def __init__(self, window: int = FLAT_DEFAULT, grace_ms: int = 0):
        self.window, self.grace = window, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Readings of a key go into state and out of it together: a call for each would be most of the work.
        self.waiting = handle.getListState("waiting", "us bigint, packet_id bigint, value double")
        self.run = handle.getValueState("run", "value double, length bigint, wake_at bigint")

    def _edge(self, timerValues) -> int:
        """Moment up to which readings are taken."""
        mark = timerValues.getCurrentWatermarkInMs()
        return (mark + self.grace) * 1000 if mark > 0 else -(2**62)

    def _at(self, us: int) -> int:
        return -(-us // 1000) - self.grace

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        edge, found = self._edge(timerValues), []
        for row in rows:
            us = _micros(row["time"])
            if us <= edge:
                yield self._out(key, row["value"], row["time"], late=True)
            else:
                found.append((us, row["packet_id"], row["value"]))
        if found:
            self.waiting.appendList(found)
            value, length, now = self.run.get() or (None, 0, None)
            at = self._at(min(us for us, _, _ in found))
            if now is None or at < now:
                if now is not None:
                    self.handle.deleteTimer(now)
                self.handle.registerTimer(at)
                self.run.update((value, length, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        edge = self._edge(timerValues)
        # Of two copies of a reading the last one counts.
        all_ = sorted({(us, packet): reading for us, packet, reading in self.waiting.get()}.items(), key=lambda x: x[0])
        value, length, _ = self.run.get()
        taken = bisect_right(all_, edge, key=lambda x: x[0][0])
        for (us, _), reading in all_[:taken]:
            length = length + 1 if reading == value else 1
            value = reading
            if length >= self.window:
                yield self._out(key, value, _moment(us), late=False)
        at = None
        if taken < len(all_):
            at = self._at(all_[taken][0][0])
            self.handle.registerTimer(at)
            self.waiting.put([(us, packet, reading) for (us, packet), reading in all_[taken:]])
        else:
            self.waiting.clear()
        self.run.update((value, length, at))

    def _out(self, key, value, moment, late: bool) -> Row:
        return Row(
            mesh_id=key[0], device_id=key[1], channel=key[2], detector="stuck_value", source="stream", value=value,
            message="too late" if late else STUCK_TEXT % (value, self.window), triggered_at=moment, is_late=late,
        )

    def close(self) -> None:
        pass


class Absence(StatefulProcessor):
    """T-08: one event-time timer per device, moved on by every packet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, deadline_ms bigint, interval int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, deadline, interval = self.seen.get() if self.seen.exists() else (None, None, None)
        for row in rows:
            now = _micros(row["time"])
            if last is None or now > last:
                last, interval = now, row["publish_interval_seconds"]
        moved = last // 1000 + interval * SILENT_INTERVALS * 1000
        if moved != deadline:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            self.handle.registerTimer(moved)
            self.seen.update((last, moved, interval))
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last, interval = _micros(initialState["last_time"]), initialState["publish_interval_seconds"]
        deadline = last // 1000 + interval * SILENT_INTERVALS * 1000
        self.handle.registerTimer(deadline)
        self.seen.update((last, deadline, interval))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, deadline, interval = self.seen.get()
        yield Row(
            mesh_id=key[0],
            device_id=key[1],
            channel=None,
            detector="absence",
            source="stream",
            value=None,
            message=f"No packet since {_moment(last):%Y-%m-%d %H:%M:%S}, over {SILENT_INTERVALS}x the {interval}s publish interval",
            triggered_at=_moment(deadline * 1000),
        )

    def close(self) -> None:
        pass


def stuck_value_stream(readings: DataFrame, window: int = FLAT_DEFAULT) -> DataFrame:
    """`readings`: mesh_id, node_id, field, value, time, packet_id."""
    usable = readings.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.groupBy("mesh_id", "node_id", "field").transformWithState(
        statefulProcessor=StuckValue(window), outputStructType=_ALARM, outputMode="append", timeMode="none"
    )


def cool_down_stream(alarms: DataFrame, cooldown_seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alarms that are let through; routing belongs before this step."""
    return alarms.groupBy("mesh_id", "device_id", "channel", "detector").transformWithState(
        statefulProcessor=CoolDown(cooldown_seconds),
        outputStructType=alarms.schema,
        outputMode="append",
        timeMode="none",
    )


def ordered_stuck_value_stream(
    readings: DataFrame, window: int = FLAT_DEFAULT, late_seconds: int = 600, grace_seconds: int = 86_400
) -> DataFrame:
    """Stuck values over readings that may be up to `late_seconds` behind the
    latest one, whatever micro-batch they come in. Rows with `is_late` are
    readings behind that by up to the grace, for a table of their own; what is
    later still is dropped and counted by the engine."""
    usable = readings.where(F.col("value").isNotNull() & ~F.isnan("value"))
    columns = ("mesh_id", "node_id", "field", "value", "time", "packet_id")
    return (
        usable.select(*columns)
        .withWatermark("time", f"{late_seconds + grace_seconds} seconds")
        .groupBy("mesh_id", "node_id", "field")
        .transformWithState(
            statefulProcessor=OrderedRuns(window, grace_seconds * 1000),
            outputStructType=T.StructType([*_ALARM.fields, T.StructField("is_late", T.BooleanType())]),
            outputMode="append",
            timeMode="eventTime",
        )
    )


def absence_stream(packets: DataFrame, devices: DataFrame, late: str = "10 minutes", last_seen: DataFrame | None = None) -> DataFrame:
    """Devices that fall silent. `packets`: mesh_id, node_id, time.

    The watermark bounds how late a packet may be and drives the timers. With
    `last_seen` (mesh_id, node_id, last_time, one row each) a new query begins
    with what the store knows: devices that were heard before it and never
    since have their timers too.
    """
    watched = devices.where(F.coalesce("publish_interval_seconds", F.lit(0)) > 0).select(
        "mesh_id", F.col("device_id").alias("node_id"), "publish_interval_seconds"
    )
    known = None
    if last_seen is not None:
        known = last_seen.select("mesh_id", "node_id", "last_time").join(watched, ["mesh_id", "node_id"]).groupBy("mesh_id", "node_id")
    return (
        packets.withWatermark("time", late)
        .join(watched, ["mesh_id", "node_id"])
        .groupBy("mesh_id", "node_id")
        .transformWithState(
            statefulProcessor=Absence(), outputStructType=_ALARM, outputMode="append", timeMode="eventTime", initialState=known
        )
    )
