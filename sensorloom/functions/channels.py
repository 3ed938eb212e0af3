"""Channel names: one series is addressed as `<measurement>.<field>`.

A payload kind is `<namespace>:<variant>` or a bare word. The measurement is
what follows the first colon, or the whole kind where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Namespaces of payload kinds and the origin each stands for.
ORIGIN_BY_NAMESPACE = {
    "telemetry": "measured",
    "derived": "derived",
    "quality": "quality",
}
ORIGIN_OTHER = "other"
ORIGIN_MEASURED = "measured"
COMPUTED_MEASUREMENTS = ("derived", "quality")

# Fixed value: the characters allowed in measurement and field names.
IDENTIFIER = r"^[A-Za-z0-9_:.\-]+$"


def measurement_of(kind: Column) -> Column:
    known = F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))
    colon = F.instr(known, ":")
    return F.when(colon > 0, F.substr(known, colon + 1)).otherwise(known)


def namespace_of(kind: Column) -> Column:
    return F.substring_index(F.coalesce(kind, F.lit("")), ":", 1)


def channel_name(kind: Column, field: Column) -> Column:
    return F.concat_ws(".", measurement_of(kind), field)


def origin_of(kind: Column) -> Column:
    namespace = namespace_of(kind)
    chain = F
    for name, origin in ORIGIN_BY_NAMESPACE.items():
        chain = chain.when(namespace == name, origin)
    return chain.otherwise(ORIGIN_OTHER)


def origin_of_measurement(measurement: Column) -> Column:
    return F.when(measurement.isin(*COMPUTED_MEASUREMENTS), measurement).otherwise(ORIGIN_MEASURED)


def split_channel(channel: Column) -> Column:
    """Struct (measurement, field), or null where the channel is malformed."""
    dot = F.instr(channel, ".")
    left = F.substr(channel, F.lit(1), dot - 1)
    right = F.substr(channel, dot + 1)
    well_formed = (dot > 1) & left.rlike(IDENTIFIER) & right.rlike(IDENTIFIER)
    return F.when(well_formed, F.struct(left.alias("measurement"), right.alias("field")))


def gateway_key(device_id: Column) -> Column:
    """Node number as the text a gateway announces itself with."""
    return F.format_string("!%08x", device_id)


def node_key(mesh_id: Column, device_id: Column) -> Column:
    return F.concat_ws(":", mesh_id, device_id.cast("string"))
