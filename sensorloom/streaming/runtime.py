"""Starting streaming queries: state store, partitions, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import session

# Age and size at which the archive writer flushes.
FLUSH_SECONDS, FLUSH_RECORDS = 60, 1000


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings a stateful query takes over when it starts.

    The number of state partitions is fixed for the life of a checkpoint, so it
    is what the job or its session says and not what happens to be running when
    the query first starts.
    """
    session.prepare_streaming(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def start(
    stream: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every_seconds: int | None = None,
    output_mode: str = "append",
    partitions: int | None = None,
) -> StreamingQuery:
    """T-04, T-09: run `write_batch` on every micro-batch.

    Offsets are committed after the batch is written and a batch that failed
    runs again under the same number, so `write_batch` must replace what that
    number wrote before. Without `every_seconds` the query stops once it has
    caught up with its source.
    """
    with state_settings(stream.sparkSession, partitions):
        writer = stream.writeStream.outputMode(output_mode).foreachBatch(write_batch)
        writer = writer.option("checkpointLocation", checkpoint)
        if every_seconds is None:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=f"{every_seconds} seconds")
        return writer.start()


# Parts a micro-batch is cut into, for each task that can run at a time.
PARTS = 3


def spread(packets: DataFrame, by: str = "packet_id") -> DataFrame:
    """Packets over all tasks, however few files they come from and however
    uneven these are, and in no more parts than keep the tasks busy: taking a
    payload apart costs far more than moving it, and parts times partitions is
    what the next shuffle has of blocks."""
    return packets.repartition(PARTS * packets.sparkSession.sparkContext.defaultParallelism, by)


def run_until_caught_up(*args, **kwargs) -> StreamingQuery:
    query = start(*args, **kwargs)
    query.awaitTermination()
    return query
