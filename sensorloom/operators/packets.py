"""From packets to decoded events, sightings and discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvalues as J
from ..functions.channels import measurement_of, node_key

# Ports with a payload kind of their own.
KIND_BY_PORT = {3: "position", 4: "nodeinfo", 67: "telemetry"}

DECODED_COLUMNS = (
    "node_id",
    "packet_id",
    "portnum",
    "rx_time",
    "hop_start",
    "channel_id",
    "gateway_id",
    "mesh_id",
    "payload_kind",
    "payload",
)
ARCHIVE_COLUMNS = (*DECODED_COLUMNS[:-1], "payload_json")

# Drop reasons, in the order in which they are looked for.
UNREGISTERED, REJECTED, UNDECRYPTABLE, NO_SCHEMA = (
    "unregistered_gateway",
    "rejected_node",
    "undecryptable",
    "no_schema",
)


def payload_kind(portnum: Column, variant: Column) -> Column:
    """P-14: kind of payload from the port and, for telemetry, its variant."""
    base = F
    for port, name in KIND_BY_PORT.items():
        base = base.when(portnum == port, name)
    base = base.otherwise(F.concat(F.lit("portnum:"), portnum.cast("string")))
    named = (base == "telemetry") & (F.coalesce(variant, F.lit("")) != "")
    return F.when(named, F.concat(base, F.lit(":"), variant)).otherwise(base)


def gate(envelopes: DataFrame, gateways: DataFrame, rejections: DataFrame) -> DataFrame:
    """J-01, J-02, P-19: add mesh_id and drop_reason to every packet.

    Both lookups are left joins on unique keys, so one pass over the packets
    yields the kept ones and the reasons for the others. Join strategy is left
    to the engine, which knows the size of the registry: a small one is sent
    to all tasks, a large one is shuffled with hot gateways split.
    """
    registered = gateways.select(
        "gateway_id", F.nullif("mesh_id", F.lit("")).alias("mesh_id"), F.lit(True).alias("_known")
    )
    rejected = rejections.select(
        F.col("mesh_id").alias("_mesh"), F.col("device_id").alias("_node"), F.lit(True).alias("_rejected")
    ).distinct()
    joined = envelopes.join(registered, "gateway_id", "left").join(
        rejected, (F.col("mesh_id") == F.col("_mesh")) & (F.col("node_id") == F.col("_node")), "left"
    )
    reason = (
        F.when(F.col("_known").isNull(), UNREGISTERED)
        .when(F.col("_rejected"), REJECTED)
        .when(~F.coalesce("decryptable", F.lit(True)), UNDECRYPTABLE)
        .when(F.col("payload").isNull(), NO_SCHEMA)
    )
    return joined.withColumn("drop_reason", reason).drop("_known", "_mesh", "_node", "_rejected")


def drop_messages(gated: DataFrame) -> DataFrame:
    """Dropped packets with the reason spelled out."""
    node = node_key(F.col("mesh_id"), F.col("node_id"))
    text = (
        F.when(
            F.col("drop_reason") == UNREGISTERED,
            F.concat(F.lit("unregistered gateway "), F.coalesce("gateway_id", F.lit("unparseable"))),
        )
        .when(F.col("drop_reason") == REJECTED, F.concat(F.lit("rejected node "), node))
        .when(
            F.col("drop_reason") == UNDECRYPTABLE,
            F.format_string(
                "cannot decrypt packet of node %d heard by %s: wrong mesh key", "node_id", "gateway_id"
            ),
        )
        .otherwise(F.format_string("portnum %d has no schema", "portnum"))
    )
    return gated.where(F.col("drop_reason").isNotNull()).withColumn("message", text)


def drop_counts(gated: DataFrame) -> DataFrame:
    """A-16."""
    return (
        gated.where(F.col("drop_reason").isNotNull())
        .groupBy("drop_reason")
        .agg(F.count(F.lit(1)).alias("packets"))
    )


def decoded(gated: DataFrame, *also: str) -> DataFrame:
    """P-20: the kept packets in the shape every later job reads, and columns
    one job hands on to itself."""
    kept = gated.where(F.col("drop_reason").isNull())
    return kept.withColumn("payload_kind", payload_kind(F.col("portnum"), F.col("variant"))).select(
        *DECODED_COLUMNS, *also
    )


def archive_rows(events: DataFrame) -> DataFrame:
    """P-01: the ten archive columns; absent ones are null."""
    present = set(events.columns)
    columns = [
        F.col(name) if name in present else F.lit(None).cast("string").alias(name)
        for name in DECODED_COLUMNS[:-1]
    ]
    return events.select(*columns, F.coalesce("payload", F.lit("{}")).alias("payload_json"))


def with_variant(events: DataFrame, into: str = "_payload") -> DataFrame:
    return events.withColumn(into, F.try_parse_json("payload"))


def _member(name: str, kind: str) -> Column:
    return F.try_variant_get("_payload", f"$.{name}", kind)


def truthy_text(value: Column) -> Column:
    """Text of a JSON value; null where it is empty, zero, false or missing."""
    kind = J.type_name(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "True"))
        .when(J.numeric_kind(kind), F.when(J.as_double(value) != 0, text))
    )


# Node-info members and the registry columns they fill.
IDENTITY_FIELDS = {
    "long_name": "name",
    "short_name": "short_name",
    "hw_model": "hardware_type",
    "role": "role",
}


def of_known_mesh() -> Column:
    return F.coalesce("mesh_id", F.lit("")) != ""


def own_fields() -> Column:
    """Numeric fields a telemetry payload carries for its own variant."""
    variant = F.substr(F.col("payload_kind"), F.lit(len("telemetry:") + 1))
    sub = F.try_element_at(J.as_object(F.col("_payload")), variant)
    fields = F.transform(F.filter(J.members(sub), lambda m: J.numeric_kind(m["kind"])), lambda m: m["key"])
    return F.coalesce(fields, F.array().cast("array<string>"))


def sightings(events: DataFrame) -> DataFrame:
    """P-15: one row per decoded event of a known mesh."""
    position = F.col("payload_kind") == "position"
    info = F.col("payload_kind") == "nodeinfo"
    latitude, longitude = _member("latitude_i", "double"), _member("longitude_i", "double")
    both = position & latitude.isNotNull() & longitude.isNotNull()
    identity = [
        F.when(info, truthy_text(F.try_variant_get("_payload", f"$.{source}", "variant"))).alias(target)
        for source, target in IDENTITY_FIELDS.items()
    ]
    return with_variant(events.where(of_known_mesh())).select(
        node_key(F.col("mesh_id"), F.col("node_id")).alias("key"),
        "mesh_id",
        F.col("node_id").alias("device_id"),
        F.when(both, latitude / 1e7).alias("latitude"),
        F.when(both, longitude / 1e7).alias("longitude"),
        *identity,
        F.timestamp_seconds("rx_time").alias("seen_at"),
        F.lit("upsert").alias("op"),
    )


def discoveries(events: DataFrame) -> DataFrame:
    """P-16: the numeric fields a telemetry packet carries for its own variant."""
    own = events.where(of_known_mesh() & F.col("payload_kind").startswith("telemetry:"))
    return (
        with_variant(own)
        .withColumn("fields", own_fields())
        .where(F.size("fields") > 0)
        .select(
            "mesh_id",
            F.col("node_id").alias("device_id"),
            "payload_kind",
            "fields",
            F.lit(None).cast("map<string,string>").alias("field_units"),
            F.timestamp_seconds("rx_time").alias("seen_at"),
            F.lit("upsert").alias("op"),
        )
    )


def observations(events: DataFrame, include_time: bool = True) -> DataFrame:
    """P-10: every number of a payload under its own name, the path is lost."""
    rows = J.explode_numbers(with_variant(events.select("mesh_id", "node_id", "packet_id", "rx_time", "payload")))
    if not include_time:
        rows = rows.where(F.col("_leaf.top").isNotNull() | (F.col("_leaf.key") != "time"))
    return rows.select(
        "mesh_id",
        "node_id",
        "packet_id",
        F.col("_leaf.key").alias("field"),
        F.col("_leaf.value").alias("value"),
        F.timestamp_seconds("rx_time").alias("time"),
    )


def channels_in(events: DataFrame) -> DataFrame:
    """P-11: every number of a payload under its channel name."""
    leaf = F.col("_leaf")
    slim = events.select("mesh_id", "node_id", "packet_id", "rx_time", "payload_kind", "payload")
    return (
        J.explode_numbers(with_variant(slim))
        .where(F.coalesce(leaf["top"], leaf["key"]) != "time")
        .select(
            "mesh_id",
            "node_id",
            "packet_id",
            "rx_time",
            F.concat_ws(
                ".", F.coalesce(leaf["top"], measurement_of(F.col("payload_kind"))), leaf["key"]
            ).alias("channel"),
            leaf["value"].alias("value"),
        )
    )
