"""Event feeds: packets, configuration topics and JSON event topics.

The same readers serve a message bus in production and plain files in tests;
the format and its options are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EARLIEST, LATEST = "earliest", "latest"
# Records per poll of the decoder, the point writer and the
# registry consumers.
DECODER_BATCH, WRITER_BATCH, REGISTRY_BATCH = 100, 1000, 500


def bus_options(
    servers: str, topics: str, start: str = EARLIEST, max_records: int | None = None, **extra: str
) -> dict[str, str]:
    """Options of a bus source. Data and configuration are read from the
    earliest offset; notifications from the latest, to avoid a burst (T-07)."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics,
        "startingOffsets": start,
        # A record that retention removed before it was read fails the query
        # instead of being passed over.
        "failOnDataLoss": "true",
        **extra,
    }
    if max_records:
        options["maxOffsetsPerTrigger"] = str(max_records)
    return options


def open_stream(
    spark: SparkSession, fmt: str, options: Mapping[str, str], schema: str | None = None, path: str | None = None
) -> DataFrame:
    """S-01, S-02, S-03 as a stream.

    A micro-batch is bounded even where the caller gives no limit, for keyed
    state puts the rows of one key and batch in order.
    """
    limit = {"maxOffsetsPerTrigger": "200000"} if fmt == "kafka" else {"maxFilesPerTrigger": "8"}
    given = {name.lower() for name in options}
    if fmt in ("rate", "socket") or given & {"maxoffsetspertrigger", "maxfilespertrigger", "maxbytespertrigger"}:
        limit = {}
    reader = spark.readStream.format(fmt).options(**{**limit, **options})
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def open_batch(
    spark: SparkSession, fmt: str, options: Mapping[str, str], schema: str | None = None, path: str | None = None
) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def parse_events(records: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """S-03, T-09: JSON text records as columns, plus `reject_reason`.

    A record that is no JSON object is marked and kept for the dead letters;
    a JSON null or a null record is no event and no error, and is left out.
    """
    text = F.col(value).cast("string")
    target = T.StructType.fromDDL(f"{schema}, _bad string")
    parsed = F.from_json(text, target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    json = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))
    names = [f.name for f in target if f.name != "_bad"]
    return (
        records.where(text.isNotNull() & (F.trim(text) != "null"))
        .withColumn("_json", parsed)
        .withColumn(
            "reject_reason",
            F.when(json.isNull(), "not_json")
            .when(~is_object, "not_an_object")
            .when(F.col("_json._bad").isNotNull(), "wrong_type"),
        )
        .select(*[F.col(f"_json.{n}").alias(n) for n in names], text.alias("raw"), "reject_reason")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("raw", "reject_reason")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")
