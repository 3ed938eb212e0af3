"""A changelog kept as its latest versions, in levels that are merged as they fill up (S-02, T-01).

Folding a changelog from its beginning for every micro-batch costs what its
history weighs. Here each set of new changes becomes a *segment*: the newest
version of every key in it, deletes included. When a level holds `FAN_IN`
segments they are merged into one of the next level, so a row is rewritten
once per level and a table of n sets has about log(n) segments. What is read
is bounded by the live keys and the young segments, not by the history.

A *pointer*, written last, names the segments of a version and the offset up
to which changes are in it. A reader takes the newest pointer; segments that
none names (of a writer that died) are not seen and can be swept away.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changelog import latest_per_key, newest_per_key
from . import files

FAN_IN = 4


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    rows: int


@dataclass(frozen=True)
class Version:
    """What a pointer says. `marks` tells which version each of the last
    consumers' batches was given, so that a batch that is run again is given
    the same one."""

    number: int
    offset: int | None
    segments: tuple[Segment, ...]
    marks: tuple[tuple[int, int], ...] = ()

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)


class LevelTable:
    """One writer, any number of readers. `version` is the column that orders
    changes: an offset of the changelog, rising as it grows."""

    def __init__(self, path: str, schema: str, key: Sequence[str] = ("key",), version: str = "version", fan_in: int = FAN_IN):
        self.path, self.schema, self.key, self.order, self.fan_in = path.rstrip("/"), schema, tuple(key), version, fan_in

    # --- versions ---------------------------------------------------------

    def _pointers(self, spark: SparkSession) -> list[int]:
        found = files.names(spark, f"{self.path}/pointers")
        return [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith(".")]

    def version(self, spark: SparkSession, number: int | None = None) -> Version:
        """The newest version, or the one asked for."""
        numbers = self._pointers(spark)
        if not numbers:
            return Version(0, None, ())
        number = numbers[-1] if number is None else number
        said = json.loads(files.read_text(spark, f"{self.path}/pointers/{number:012d}.json"))
        return Version(number, said["offset"], tuple(Segment(**s) for s in said["segments"]), tuple(map(tuple, said["marks"])))

    def _publish(self, spark: SparkSession, after: Version, offset: int | None, segments: Sequence[Segment], batch: int | None) -> Version:
        number = after.number + 1
        marks = (*after.marks, (batch, number))[-8:] if batch is not None else after.marks
        said = {"offset": offset, "segments": [vars(s) for s in segments], "marks": marks}
        files.create_text(spark, f"{self.path}/pointers/{number:012d}.json", json.dumps(said))
        return Version(number, offset, tuple(segments), marks)

    # --- reading ----------------------------------------------------------

    def _of(self, spark: SparkSession, segments: Sequence[Segment]) -> DataFrame:
        paths = [f"{self.path}/segments/{s.name}" for s in segments]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, version: Version | None = None) -> DataFrame:
        """Live rows: the newest version of each key, unless it is a delete."""
        version = version or self.version(spark)
        return latest_per_key(self._of(spark, version.segments), self.key, (self.order,))

    # --- writing ----------------------------------------------------------

    def _write(self, rows: DataFrame, level: int) -> Segment:
        name = f"{level}-{uuid4().hex}"
        path = f"{self.path}/segments/{name}"
        rows.write.parquet(path)
        return Segment(name, level, rows.sparkSession.read.schema(self.schema).parquet(path).count())

    def _merged(self, spark: SparkSession, segments: list[Segment]) -> list[Segment]:
        """Segments, oldest first, with full levels merged. Where nothing older
        is left the merged segment needs no deletes any more."""
        while True:
            level = next((s.level for s in segments if sum(x.level == s.level for x in segments) >= self.fan_in), None)
            if level is None:
                return segments
            full = [s for s in segments if s.level == level]
            older = [s for s in segments if s.level > level]
            fold = newest_per_key if older else latest_per_key
            made = self._write(fold(self._of(spark, full), self.key, (self.order,)), level + 1)
            segments = [*older, made, *(s for s in segments if s.level < level)]

    def append(self, changes: DataFrame, batch: int | None = None) -> Version:
        """Take in changes beyond the offset of the newest version."""
        spark = changes.sparkSession
        now = self.version(spark)
        # Rows without a key are no versions of anything, but they have been read.
        offset = changes.agg(F.max(self.order)).first()[0]
        if offset is None:
            return self._publish(spark, now, now.offset, now.segments, batch) if batch is not None else now
        columns = spark.createDataFrame([], self.schema).columns
        made = self._write(newest_per_key(changes.select(*columns), self.key, (self.order,)), 0)
        segments = self._merged(spark, [*now.segments, made]) if made.rows else now.segments
        return self._publish(spark, now, offset, segments, batch)

    def catch_up(self, spark: SparkSession, read_since: Callable[[SparkSession, int | None], DataFrame], batch: int | None = None) -> Version:
        """Take in what the changelog has beyond the last offset. A consumer's
        batch that was given a version before is given that version again."""
        now = self.version(spark)
        given = dict(now.marks).get(batch)
        if given is not None:
            return self.version(spark, given)
        return self.append(read_since(spark, now.offset), batch)

    def sweep(self, spark: SparkSession, keep: int = 8) -> int:
        """Remove all but the newest pointers, and segments that none of these
        names. Returns the number of segments removed. Call it from the writer."""
        numbers = self._pointers(spark)
        used = {s.name for n in numbers[-keep:] for s in self.version(spark, n).segments}
        for n in numbers[:-keep]:
            files.remove(spark, f"{self.path}/pointers/{n:012d}.json")
        gone = [n for n in files.names(spark, f"{self.path}/segments") if n not in used]
        for name in gone:
            files.remove(spark, f"{self.path}/segments/{name}")
        return len(gone)

