"""Session settings every job of this package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime (per-session) SQL settings. They are safe to set on a session that
# somebody else created, so `prepare` applies them to any session it is given.
RUNTIME_CONF = {
    # All epoch arithmetic and all archive partition names are in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot gateway or device shows up as one fat join partition, which the
    # engine may split.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Methods beyond this size are not compiled by the JVM's JIT; plans with
    # long payload expressions run faster outside whole-stage code then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Folders are listed by so many tasks at most, each of which takes many; a
    # task a folder, the default up to 10,000, costs more than the listing.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Replaying a micro-batch replaces exactly the partitions it wrote before.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Keyed state of the streaming jobs lives on disk, not on the heap.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def prepare_streaming(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in STATE_STORE_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app_name: str = "sensorloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATE_STORE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local path would be unreadable from the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="sensorloom-")
