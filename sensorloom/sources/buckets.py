"""Tables in hash buckets of which a change rewrites those it touches (A-10, A-11).

A version is a small pointer that says for every bucket which write it is
from; a write holds the new contents of the buckets it changed, and nothing
of the others. The pointer is written last, so a write that failed is not
seen, and readers of an older version keep their files until `sweep`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import files

BUCKETS = 256
_BUCKET = "_bucket"


class BucketTable:
    """One writer. Rows that a change must see together have equal `by`."""

    def __init__(self, path: str, schema: str, by: Sequence[str] = ("device_id",), buckets: int = BUCKETS):
        self.path, self.schema, self.by, self.buckets = path.rstrip("/"), schema, tuple(by), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.by]), F.lit(self.buckets)).cast("int")

    def _numbers(self, spark: SparkSession) -> list[int]:
        found = files.names(spark, f"{self.path}/versions")
        return [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith(".")]

    def version(self, spark: SparkSession) -> int:
        numbers = self._numbers(spark)
        if not numbers:
            raise FileNotFoundError(f"no version in {self.path}")
        return numbers[-1]

    def writes(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """The write each bucket that has rows is from."""
        number = self.version(spark) if version is None else version
        return {int(b): w for b, w in json.loads(files.read_text(spark, f"{self.path}/versions/{number:012d}.json")).items()}

    def read(self, spark: SparkSession, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets if they are named."""
        held = self.writes(spark, version)
        paths = [f"{self.path}/data/{w}/{_BUCKET}={b}" for b, w in sorted(held.items()) if buckets is None or b in set(buckets)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        write = uuid4().hex
        folder = f"{self.path}/data/{write}"
        rows.withColumn(_BUCKET, self._bucket()).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        found = files.names(rows.sparkSession, folder)
        return write, [int(n.removeprefix(f"{_BUCKET}=")) for n in found if n.startswith(f"{_BUCKET}=")]

    def _publish(self, spark: SparkSession, number: int, held: dict[int, str]) -> int:
        files.create_text(spark, f"{self.path}/versions/{number:012d}.json", json.dumps(held))
        return number

    def start(self, rows: DataFrame) -> int:
        """Version 0."""
        write, found = self._write(rows)
        return self._publish(rows.sparkSession, 0, dict.fromkeys(found, write))

    def advance(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """The next version: `change` of the buckets that rows of `keys` fall into.
        The driver sees numbers of buckets. Without keys there is no new version."""
        spark = keys.sparkSession
        number = self.version(spark)
        touched = sorted(r[0] for r in keys.select(self._bucket().alias(_BUCKET)).distinct().collect())
        if not touched:
            return number
        held = self.writes(spark, number)
        write, found = self._write(change(self.read(spark, number, touched)))
        if not set(found) <= set(touched):
            raise ValueError("a change gave rows of other keys than it was told to change")
        kept = {b: w for b, w in held.items() if b not in touched}
        return self._publish(spark, number + 1, {**kept, **dict.fromkeys(found, write)})

    def sweep(self, spark: SparkSession, keep: int = 8) -> int:
        """Remove all but the newest pointers and the buckets none of them names."""
        numbers = self._numbers(spark)
        used = {(w, b) for n in numbers[-keep:] for b, w in self.writes(spark, n).items()}
        for n in numbers[:-keep]:
            files.remove(spark, f"{self.path}/versions/{n:012d}.json")
        gone = 0
        for write in files.names(spark, f"{self.path}/data"):
            for name in files.names(spark, f"{self.path}/data/{write}"):
                if name.startswith(f"{_BUCKET}=") and (write, int(name.removeprefix(f"{_BUCKET}="))) not in used:
                    files.remove(spark, f"{self.path}/data/{write}/{name}")
                    gone += 1
        return gone
