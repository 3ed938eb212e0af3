"""What several operators of this folder need: tables, staged results, shared files, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import shared_folder

#: What a word is where a contract names `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split() cuts at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words of a text with A-Z in lower case as a JVM-side array; empty for null."""
    return F.filter(
        F.split(F.coalesce(lower_ascii(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""
    )


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run in the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Folders of the open `scratch` blocks, innermost last.
_SCRATCH: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends there, and a lost executor
    costs no more than a read. Inside `scratch` the folder goes when the block ends; else whoever runs the
    job removes it when the result is no longer read."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose staged tables are removed at its end. It gives a function that stages what is to
    outlive it; call it last, for it must not be read from tables of the block any more."""
    own: list[str] = []
    _SCRATCH.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        folder = own.pop()
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(folder)
        return out

    try:
        yield keep
    finally:
        _SCRATCH.remove(own)
        for folder in own:
            removed(spark, folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder of this run from whatever file system it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table, for loops."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession) + "/checkpoints")
    return df.checkpoint()


def _file_system(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


@contextmanager
def written(path: str) -> Iterator:
    """An output stream in a shared folder. The file bears its name only when it is whole, so a task
    that dies leaves nothing a reader would take."""
    files, at = _file_system(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, at)


def opened(path: str):
    """A sequential input stream of a file in a shared folder."""
    files, at = _file_system(path)
    return files.open_input_stream(at, compression=None)


def file_paths(folder: str) -> list[str]:
    """Whole files of a shared folder."""
    from pyarrow import fs

    files, at = _file_system(folder)
    prefix = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(prefix + x.path for x in found if x.is_file and not x.path.endswith(".part"))


#: Partial sums of a row that are added in one task at most, at each of two levels.
FAN_IN = 256


def summed_rows(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Sums of the arrays of (i, row) by i, in order. Rows of one i are added by executors in two levels, so no
    task adds those of all tasks and the driver sees one for each i."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(frame["row"].to_numpy()), axis=0)]})

    rows = rows.withColumn("part", F.expr(f"spark_partition_id() div {FAN_IN}"))
    some = rows.groupBy("i", "part").applyInPandas(add, "i int, row array<double>")
    found = some.groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    return [(r["i"], np.array(r["row"])) for r in sorted(found)]


def summed(rows: DataFrame) -> np.ndarray | None:
    """The matrix whose rows are these sums."""
    found = summed_rows(rows)
    return np.stack([row for _, row in found]) if found else None


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds `rank`, 0, 1, ... in the given order, without gathering rows in one task: rows are
    range-partitioned, numbered inside their partition and moved on by the rows before it. The driver
    sees one count per partition. Give an order without ties between different rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id()),
        "ranked",
    )
    # monotonically_increasing_id is (partition << 33) + row.
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p] = total
        total += n
    if not before:
        return dealt.withColumn("rank", F.col("__at")).drop("__at")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    return dealt.withColumn("rank", base + row).drop("__at")
