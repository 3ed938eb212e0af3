"""Small files on shared storage that appear whole or not at all."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs


def _files(spark: SparkSession, path: str):
    at = _hadoop(spark).Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    at, files = _files(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _files(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file under a name of its own, then rename it; fails if the name is taken."""
    jvm, hadoop = spark.sparkContext._jvm, _hadoop(spark)
    at, files = _files(spark, path)
    part = hadoop.Path(at.getParent(), f".{at.getName()}.{uuid4().hex}")
    out = files.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(part), files.makeQualified(at), rename)
    except Exception:
        files.delete(part, False)
        raise


def remove(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)
