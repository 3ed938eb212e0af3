"""From decoded events and alarms to time-series points, one row per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvalues as J
from .packets import truthy_text

# Payload clocks before this moment (2020-01-01) are not
# believed; the two kinds of packet that are never stored.
EARLIEST_PAYLOAD_TIME = 1577836800
SKIPPED_KINDS = ("portnum:1", "portnum:5")

EVENT_COLUMNS = ("mesh_id", "node_id", "channel_id", "gateway_id", "packet_id")


def _field(name, value=None, text=None, flag=None, kind: str | Column = "double") -> Column:
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("field"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (text if text is not None else F.lit(None)).cast("string").alias("value_str"),
        (flag if flag is not None else F.lit(None)).cast("boolean").alias("value_bool"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("value_type"),
    )


def _point(measurement: Column, fields: Column) -> Column:
    return F.struct(measurement.alias("measurement"), fields.alias("fields"))


def _number_at(name: str) -> Column:
    return J.number(F.try_variant_get("_payload", f"$.{name}", "variant"))


def _present(fields: list[Column]) -> Column:
    return F.filter(F.array(*fields), lambda f: f["value"].isNotNull())


def event_time(events: DataFrame) -> DataFrame:
    """P-02: time and timestamp_quality, in whole seconds."""
    claimed = _number_at("time")
    trusted = F.coalesce(claimed > EARLIEST_PAYLOAD_TIME, F.lit(False))
    return events.withColumn(
        "timestamp_quality", F.when(trusted, "payload").otherwise("rx_time")
    ).withColumn(
        "time", F.timestamp_seconds(F.when(trusted, claimed.cast("long")).otherwise(F.col("rx_time")))
    )


def builder(kind: Column) -> Column:
    """P-09: which of the builders below handles a payload kind."""
    kind = F.coalesce(kind, F.lit(""))
    return (
        F.when(kind.isin(*SKIPPED_KINDS), "skip")
        .when(kind.startswith("telemetry"), "telemetry")
        .when(kind == "position", "position")
        .when(kind == "nodeinfo", "nodeinfo")
        .otherwise("generic")
    )


def _with_base_fields(own: Column) -> Column:
    """packet_id and timestamp_quality are fields of every point, unless the
    payload brings a field of that name."""
    base = F.array(
        _field("packet_id", F.col("packet_id"), kind="long"),
        _field("timestamp_quality", text=F.col("timestamp_quality"), kind="string"),
    )
    replaced = F.exists(own, lambda f: f["field"].isin("packet_id", "timestamp_quality"))
    kept = F.filter(base, lambda b: ~F.exists(own, lambda f: f["field"] == b["field"]))
    return F.concat(F.when(replaced, kept).otherwise(base), own)


def _telemetry() -> Column:
    """P-04: one point per object-valued member; its values read as numbers."""

    def to_point(member: Column) -> Column:
        own = F.filter(
            F.transform(
                J.entries_with_kind(member["inner"]), lambda m: _field(m["key"], J.coerced_double(m["value"], m["kind"]))
            ),
            lambda f: f["value"].isNotNull(),
        )
        return _point(member["key"], own)

    usable = F.filter(J.objects(F.col("_payload")), lambda m: m["key"] != "time")
    return F.transform(usable, to_point)


def _position() -> Column:
    """P-05."""
    altitude = J.coerced_double(F.try_variant_get("_payload", "$.altitude", "variant"))
    own = _present(
        [
            _field("latitude", _number_at("latitude_i") / 1e7),
            _field("longitude", _number_at("longitude_i") / 1e7),
            _field("altitude", altitude),
        ]
    )
    return F.filter(F.array(_point(F.lit("position"), own)), lambda p: F.size(p["fields"]) > 0)


def _nodeinfo() -> Column:
    """P-06: identity goes to tags, so the point may have no field of its own."""
    user = truthy_text(F.try_variant_get("_payload", "$.id", "variant"))
    own = F.filter(
        F.array(_field("user_id", text=user, kind="string")), lambda f: f["value_str"].isNotNull()
    )
    return F.array(_point(F.lit("nodeinfo"), own))


def _generic() -> Column:
    """P-07: numbers and booleans of the payload itself keep their type."""

    def to_field(member: Column) -> Column:
        value, flag = member["value"], member["kind"] == "BOOLEAN"
        kind = F.when(flag, "bool").when(member["kind"] == "BIGINT", "long").otherwise("double")
        return _field(
            member["key"],
            F.when(~flag, J.as_double(value)),
            flag=F.when(flag, F.try_variant_get(value, "$", "boolean")),
            kind=kind,
        )

    usable = F.filter(
        J.members(F.col("_payload")), lambda m: J.numeric_kind(m["kind"]) | (m["kind"] == "BOOLEAN")
    )
    measurement = F.concat(F.lit("portnum_"), F.coalesce(F.col("portnum").cast("string"), F.lit("unknown")))
    return F.filter(
        F.array(_point(measurement, F.transform(usable, to_field))), lambda p: F.size(p["fields"]) > 0
    )


def _tags(extra: dict[str, Column]) -> Column:
    """Tags that are set; an empty text counts as unset (P-03)."""
    pairs = []
    for name, value in extra.items():
        pairs += [F.lit(name), F.nullif(value.cast("string"), F.lit(""))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def event_points(events: DataFrame) -> DataFrame:
    """P-02 to P-07 and P-09 for decoded events, in one pass over them.

    Each row picks its builder by payload kind, the builder makes an array of
    fields inside the row, and a single explode spreads it. Nothing is
    shuffled and the events are read once, whatever mix of kinds they hold.
    The explodes are outer ones because for an inner one the optimizer adds a
    filter that would build each array twice more, only to see if it is empty.
    """
    arrival = ["arrival"] if "arrival" in events.columns else []
    tag = lambda name: truthy_text(F.try_variant_get("_payload", f"$.{name}", "variant"))
    identity = _tags({name: tag(name) for name in ("hw_model", "long_name", "role", "short_name")})
    rows = (
        events.withColumn("_builder", builder(F.col("payload_kind")))
        .where(F.col("_builder") != "skip")
        .withColumn("_payload", F.try_parse_json("payload"))
    )
    rows = (
        event_time(rows)
        .withColumn(
            "tags",
            F.when(F.col("_builder") == "nodeinfo", identity).otherwise(F.create_map().cast("map<string,string>")),
        )
        .withColumn(
            "_points",
            F.when(F.col("_builder") == "telemetry", _telemetry())
            .when(F.col("_builder") == "position", _position())
            .when(F.col("_builder") == "nodeinfo", _nodeinfo())
            .otherwise(_generic()),
        )
        .select(*EVENT_COLUMNS, *arrival, "timestamp_quality", "time", "tags", F.explode_outer("_points").alias("_point"))
        .where(F.col("_point").isNotNull())
        .select(
            *EVENT_COLUMNS,
            *arrival,
            "timestamp_quality",
            "time",
            "tags",
            F.col("_point.measurement").alias("measurement"),
            F.explode_outer(_with_base_fields(F.col("_point.fields"))).alias("_field"),
        )
    )
    return rows.select(
        F.nullif("mesh_id", F.lit("")).alias("mesh_id"),
        "node_id",
        F.nullif("channel_id", F.lit("")).alias("channel_id"),
        F.nullif("gateway_id", F.lit("")).alias("gateway_id"),
        "measurement",
        F.col("_field.field").alias("field"),
        F.concat_ws(".", "measurement", "_field.field").alias("channel"),
        "_field.value",
        "_field.value_str",
        "_field.value_bool",
        "_field.value_type",
        "tags",
        "packet_id",
        "timestamp_quality",
        "time",
        *arrival,
    )


def alarm_points(alarms: DataFrame) -> DataFrame:
    """P-08: an alarm as a point; older column names are still read."""
    have = set(alarms.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have])
    device = pick("device_id", "node_id").cast("long")
    subject = F.nullif(pick("channel", "field"), F.lit(""))
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    fields = F.filter(
        F.array(
            _field("message", text=F.coalesce(optional("message", "string"), F.lit("")), kind="string"),
            _field("value", optional("value", "double")),
        ),
        lambda f: f["value"].isNotNull() | f["value_str"].isNotNull(),
    )
    tags = {"channel": subject, "detector": F.col("detector"), "source": optional("source", "string")}
    return alarms.select(
        F.nullif(optional("mesh_id", "string"), F.lit("")).alias("mesh_id"),
        device.alias("node_id"),
        F.explode(fields).alias("_field"),
        _tags(tags).alias("tags"),
        *(["arrival"] if "arrival" in have else []),
        F.col("triggered_at").cast("timestamp").alias("time"),
    ).select(
        "mesh_id",
        "node_id",
        F.lit(None).cast("string").alias("channel_id"),
        F.lit(None).cast("string").alias("gateway_id"),
        F.lit("alarms").alias("measurement"),
        F.col("_field.field").alias("field"),
        F.concat_ws(".", F.lit("alarms"), "_field.field").alias("channel"),
        "_field.value",
        "_field.value_str",
        "_field.value_bool",
        "_field.value_type",
        "tags",
        F.lit(None).cast("long").alias("packet_id"),
        F.lit(None).cast("string").alias("timestamp_quality"),
        "time",
        *(["arrival"] if "arrival" in have else []),
    )


def all_points(events: DataFrame) -> DataFrame:
    """P-09 over a mixed feed: rows with a detector are alarms (U-02)."""
    is_alarm = F.col("detector").isNotNull()
    return event_points(events.where(~is_alarm)).unionByName(alarm_points(events.where(is_alarm)))


def mixed_feed(decoded: DataFrame, alarms: DataFrame) -> DataFrame:
    """U-02: decoded events and alarms as one input of the point writer."""
    return decoded.unionByName(alarms, allowMissingColumns=True)


POINT_KEY = ("mesh_id", "node_id", "channel_id", "gateway_id", "measurement", "field", "time", "_tags")


def dedupe_points(points: DataFrame, *newest: str) -> DataFrame:
    """Keep one row per point key, the last written one.

    `newest` orders the writes. The rows of one key are aggregated, not
    ranked, so many copies of a point collapse before the shuffle.
    """
    order = F.struct(*newest) if newest else F.struct("packet_id")
    value_columns = [c for c in points.columns if c not in POINT_KEY]
    return (
        points.withColumn("_tags", F.to_json("tags"))
        .groupBy(*POINT_KEY)
        .agg(
            F.max_by(
                F.struct(*[F.col(c) for c in value_columns]), order
            ).alias("_r")
        )
        .select(*[F.col(c) if c in POINT_KEY else F.col(f"_r.{c}").alias(c) for c in points.columns])
    )
