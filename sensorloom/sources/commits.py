"""Batches whose tables become visible together (T-04, S-10).

A micro-batch writes several tables one by one. A record of what is whole is
written last; readers take the newest record and see of every table the
batches it names. What a batch that died has written is not seen, is replaced
when the batch runs again, and can be swept away.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import files
from .store import BATCH

Ranges = list[list[int]]


def with_batch(ranges: Ranges, batch: int) -> Ranges:
    """Ranges of numbers, both ends included, and one number more."""
    out: Ranges = []
    for low, high in sorted([*ranges, [batch, batch]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


class Commits:
    """The record of one root folder: one writer, any number of readers.

    Batches come in order, so their numbers are a few ranges and the newest
    record, which has all of them, stays small.
    """

    def __init__(self, root: str):
        self.root, self.folder = root, f"{root}/_commits"

    def _numbers(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(spark, self.folder) if n.endswith(".json") and not n.startswith(".")]

    def ranges(self, spark: SparkSession) -> Ranges:
        numbers = self._numbers(spark)
        return json.loads(files.read_text(spark, f"{self.folder}/{numbers[-1]:012d}.json")) if numbers else []

    def holds(self, spark: SparkSession, batch: int) -> bool:
        return any(low <= batch <= high for low, high in self.ranges(spark))

    def commit(self, spark: SparkSession, *batches: int, keep: int = 100) -> None:
        numbers, ranges = self._numbers(spark), self.ranges(spark)
        for batch in batches:
            ranges = with_batch(ranges, batch)
        files.create_text(spark, f"{self.folder}/{(numbers[-1] if numbers else 0) + 1:012d}.json", json.dumps(ranges))
        for number in numbers[: -keep]:
            files.remove(spark, f"{self.folder}/{number:012d}.json")

    def visible(self, spark: SparkSession) -> Column:
        """A filter on the batch folders; it prunes them before files are listed for a read."""
        out = F.lit(False)
        for low, high in self.ranges(spark):
            out = out | F.col(BATCH).between(low, high)
        return out

    def read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """Rows of all committed batches, with the batch they came in."""
        if not any(n.startswith(f"{BATCH}=") for n in files.names(spark, f"{self.root}/{table}")):
            return spark.createDataFrame([], f"{schema}, {BATCH} bigint")
        rows = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(f"{self.root}/{table}")
        return rows.where(self.visible(spark))

    def sweep(self, spark: SparkSession, tables: Sequence[str]) -> list[str]:
        """Remove folders of batches that were never committed. Call it from the
        writer, between batches."""
        gone = []
        for table in tables:
            for name in files.names(spark, f"{self.root}/{table}"):
                number = name.removeprefix(f"{BATCH}=")
                if name.startswith(f"{BATCH}=") and number.isdigit() and not self.holds(spark, int(number)):
                    files.remove(spark, f"{self.root}/{table}/{name}")
                    gone.append(f"{table}/{name}")
        return gone
