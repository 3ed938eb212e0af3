"""A folder a value, on a file system that is mounted.

Without its native library Hadoop starts a process for every folder and file it
makes there: of an archive with a folder a node, five a node. Here the tasks
make them themselves. A batch appears whole: what the tasks wrote is put
together aside and renamed to its name, so what a task that failed or ran twice
has left is never seen. They also list them for a read: the engine's reader
holds some kilobytes a file on the driver, and tries to guess the types of names.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator, Sequence
from itertools import groupby
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import files

# What the engine escapes in the name of a partition, and its name for a missing value.
_ESCAPED = {chr(c) for c in (*range(1, 32), 127)} | set("\"#%'*/:=?\\{[]^")
_MISSING = "__HIVE_DEFAULT_PARTITION__"
_ROW_METADATA = "org.apache.spark.sql.parquet.row.metadata"


def mounted(spark: SparkSession, path: str) -> str | None:
    """Where a folder is for all processes, if its file system is mounted."""
    at, system = files._files(spark, path)
    return system.makeQualified(at).toUri().getPath() if system.getUri().getScheme() == "file" else None


def name_of(column: str, value: str | None) -> str:
    text = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value) if value else _MISSING
    return f"{column}={text}"


def _merge(source: str, into: str) -> None:
    """Move what is in a folder into another; a folder that both have is gone through."""
    with os.scandir(source) as entries:
        for entry in entries:
            there = f"{into}/{entry.name}"
            if os.path.isdir(there):
                _merge(entry.path, there)
            else:
                os.rename(entry.path, there)


def write_folders(rows: DataFrame, at: str, partitions: Sequence[str]) -> None:
    """Rows as Parquet files below `at`, in the folders the engine would write;
    what was there is replaced. A task holds one file open at a time."""
    data = [c for c in rows.columns if c not in partitions]
    keys = [f"_folder{i}" for i in range(len(partitions))]
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(partitions, keys)]
    # Even, as `store._write_batch` says.
    sorted_rows = rows.hint("rebalance", *partitions).select(*data, *texts).sortWithinPartitions(*keys)
    described = {_ROW_METADATA: rows.select(*data).schema.json()}
    parent, name = os.path.split(at)
    own = f".{name}."
    stage = f"{parent}/{own}{uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        attempt = uuid4().hex
        file = f"part-{TaskContext.get().partitionId():05d}-{attempt}.c000.snappy.parquet"
        os.makedirs(f"{stage}/{attempt}")
        out, current = None, None
        for batch in batches:
            found = zip(*[batch.column(k).to_pylist() for k in keys])
            values = batch.select(data).replace_schema_metadata(described)
            start = 0
            for key, same in groupby(found):
                if key != current:
                    if out:
                        out.close()
                    folder = "/".join([stage, attempt, *map(name_of, partitions, key)])
                    os.makedirs(folder)
                    out, current = parquet.ParquetWriter(f"{folder}/{file}", values.schema, store_schema=False, write_page_checksum=True), key
                rows_of_key = sum(1 for _ in same)
                out.write_batch(values.slice(start, rows_of_key))
                start += rows_of_key
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"attempt": [attempt]})

    os.makedirs(parent, exist_ok=True)
    for left in os.listdir(parent):
        # Of a run of this batch whose driver died.
        if left.startswith(own):
            shutil.rmtree(f"{parent}/{left}", ignore_errors=True)
    try:
        whole = f"{stage}/whole"
        os.makedirs(whole)
        for (attempt,) in sorted_rows.mapInArrow(write, "attempt string").collect():
            _merge(f"{stage}/{attempt}", whole)
        open(f"{whole}/_SUCCESS", "x").close()
        if os.path.lexists(at):
            os.rename(at, f"{stage}/replaced")
        os.rename(whole, at)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


# Rows in what a reading task hands on at a time, and folders of a listing one.
_ROWS = 10_000
# Parts a listing is dealt to, for each task that can run at a time.
_PARTS = 3


def _value_of(name: str) -> str | None:
    text = name.partition("=")[2]
    return None if text == _MISSING else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def _folders(at: str) -> list[str]:
    with os.scandir(at) as entries:
        return sorted(e.name for e in entries if "=" in e.name and not e.name.startswith(".") and e.is_dir())


def _files_below(at: str, values: dict[str, str | None]) -> Iterator[tuple[str, dict[str, str | None]]]:
    with os.scandir(at) as entries:
        for entry in sorted(entries, key=lambda e: e.name):
            if entry.is_dir() and "=" in entry.name:
                yield from _files_below(entry.path, values | {entry.name.partition("=")[0]: _value_of(entry.name)})
            elif entry.is_file() and not entry.name.startswith((".", "_")):
                yield entry.path, values


def read_folders(spark: SparkSession, at: str, schema: StructType, partitions: Sequence[str]) -> DataFrame:
    """Rows of Parquet files below `at`; `schema` has what is read of the files
    and the folders' values, named by `partitions`. The driver lists the first
    level, tasks the others."""
    data = [f.name for f in schema if f.name not in partitions]
    empty = spark.createDataFrame([], schema).select(*data, *[F.col(c).cast("string") for c in partitions])
    kinds = to_arrow_schema(empty.schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                for second in _folders(f"{at}/{top}"):
                    found = [f"{top}/{second}/{x}" for x in _folders(f"{at}/{top}/{second}")]
                    for i in range(0, len(found), _ROWS):
                        yield pa.RecordBatch.from_pydict({"folder": found[i : i + _ROWS]})

    def rows_of(folder: str) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        values = {x.partition("=")[0]: _value_of(x) for x in folder.split("/")}
        for path, named in _files_below(f"{at}/{folder}", values):
            with parquet.ParquetFile(path) as file:
                there = [c for c in data if c in file.schema_arrow.names]
                for rows in file.iter_batches(_ROWS, columns=there, use_threads=False):
                    own = {c: rows.column(c).cast(kinds.field(c).type) for c in there}
                    own |= {c: pa.repeat(pa.scalar(named.get(c), pa.string()), rows.num_rows) for c in partitions}
                    yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(rows.num_rows, f.type)) for f in kinds], schema=kinds)

    def whole(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return iter(pa.Table.from_batches(some).combine_chunks().to_batches())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for rows in rows_of(folder):
                    some.append(rows)
                    held += rows.num_rows
                    if held >= _ROWS:
                        yield from whole(some)
                        some, held = [], 0
        if some:
            yield from whole(some)

    tops = spark.createDataFrame([(x,) for x in _folders(at)], "folder string")
    parts = _PARTS * spark.sparkContext.defaultParallelism
    found = tops.mapInArrow(listed, "folder string").repartition(parts, "folder").mapInArrow(read, empty.schema)
    return found.select(*[F.col(f.name).cast(f.dataType) for f in schema])
