"""Packets: gate, decoding, points, archive and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels as C
from ..functions.units import quantity_kind, KIND_BY_UNIT
from ..operators import packets as K, points as P
from .registry import query
from .tables import stamp, with_views

_DECODED = "node_id, packet_id, portnum, rx_time, hop_start, channel_id, gateway_id, mesh_id, payload_kind"


@query(
    "s01_packets",
    with_views(
        "SELECT gateway_id, channel_id, node_id, packet_id, rx_time, hop_start, portnum, variant, decryptable FROM env",
        "env",
    ),
)
def packets(t):
    return t.envelopes().drop("payload")


@query(
    "p19_j01_j02_gate",
    with_views("SELECT packet_id, gateway_id, mesh_id, drop_reason FROM gated", "gated"),
)
def gate(t):
    return t.gated().select("packet_id", "gateway_id", "mesh_id", "drop_reason")


@query(
    "j01_packets_of_registered_gateways",
    with_views("SELECT packet_id, env.gateway_id, gw.mesh_id FROM env JOIN gw USING (gateway_id)", "env", "gw"),
)
def packets_of_registered_gateways(t):
    gated = t.gated().where(F.coalesce("drop_reason", F.lit("")) != K.UNREGISTERED)
    return gated.select("packet_id", "gateway_id", "mesh_id")


@query(
    "j02_packets_of_accepted_nodes",
    with_views(
        """SELECT packet_id, node_id, mesh_id FROM (SELECT packet_id, node_id, gw.mesh_id FROM env JOIN gw USING (gateway_id)) p
        WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.mesh_id = p.mesh_id AND rej.device_id = p.node_id)""",
        "env",
        "gw",
        "rej",
    ),
)
def packets_of_accepted_nodes(t):
    reason = F.coalesce("drop_reason", F.lit(""))
    return t.gated().where(~reason.isin(K.UNREGISTERED, K.REJECTED)).select("packet_id", "node_id", "mesh_id")


@query(
    "a16_drop_counts",
    with_views(
        "SELECT drop_reason, count(*) AS packets FROM gated WHERE drop_reason IS NOT NULL GROUP BY drop_reason", "gated"
    ),
)
def drop_counts(t):
    return K.drop_counts(t.gated())


@query(
    "p14_p20_decoded",
    with_views(f"SELECT {_DECODED} FROM dec", "dec"),
)
def decoded(t):
    return t.decoded().drop("payload")


@query(
    "p01_archive_rows",
    with_views(f"SELECT {_DECODED}, length(payload) AS payload_length, packet_id AS id FROM dec", "dec"),
)
def archive_rows(t):
    rows = K.archive_rows(t.decoded())
    return rows.select("*", F.length("payload_json").alias("payload_length"), F.col("packet_id").alias("id")).drop(
        "payload_json"
    )


@query(
    "p02_event_time",
    with_views(
        f"SELECT packet_id, timestamp_quality, {stamp('make_timestamp(at_s * 1000000)')} AS time FROM timed", "timed"
    ),
)
def event_time(t):
    return P.event_time(K.with_variant(t.decoded())).select("packet_id", "timestamp_quality", "time")


def _points(t):
    return P.event_points(t.decoded())


_POINT_SQL = f"""SELECT mesh_id, node_id, channel_id, gateway_id, measurement, field, measurement || '.' || field AS channel,
    round(value, 6) AS value, value_str, value_bool, value_type, packet_id, timestamp_quality,
    {stamp('make_timestamp(at_s * 1000000)')} AS time FROM packet_points"""


@query("p03_p09_points", with_views(_POINT_SQL, "packet_points"))
def points(t):
    return _points(t).drop("tags")


@query(
    "p03_point_tags",
    with_views(
        """SELECT packet_id, mesh_id, channel_id, gateway_id FROM packet_points
        WHERE field = 'timestamp_quality'""",
        "packet_points",
    ),
)
def point_tags(t):
    rows = _points(t).where(F.col("field") == "timestamp_quality")
    return rows.select("packet_id", "mesh_id", "channel_id", "gateway_id")


@query("p04_telemetry_points", with_views(_POINT_SQL + " WHERE payload_kind LIKE 'telemetry%'", "packet_points"))
def telemetry_points(t):
    return P.event_points(t.decoded().where(F.col("payload_kind").startswith("telemetry"))).drop("tags")


@query("p05_position_points", with_views(_POINT_SQL + " WHERE payload_kind = 'position'", "packet_points"))
def position_points(t):
    return P.event_points(t.decoded().where(F.col("payload_kind") == "position")).drop("tags")


@query(
    "p06_nodeinfo_points",
    with_views(
        """SELECT packet_id, field, value_str, json_extract_string(payload, '$.long_name') AS long_name,
               NULLIF(json_extract_string(payload, '$.short_name'), '') AS short_name,
               json_extract_string(payload, '$.hw_model') AS hw_model, json_extract_string(payload, '$.role') AS role
        FROM packet_points WHERE payload_kind = 'nodeinfo'""",
        "packet_points",
    ),
)
def nodeinfo_points(t):
    rows = P.event_points(t.decoded().where(F.col("payload_kind") == "nodeinfo"))
    tags = [F.col("tags")[n].alias(n) for n in ("long_name", "short_name", "hw_model", "role")]
    return rows.select("packet_id", "field", "value_str", *tags)


@query(
    "p07_generic_points",
    with_views(
        _POINT_SQL + " WHERE payload_kind LIKE 'portnum:%' AND field NOT IN ('packet_id', 'timestamp_quality')",
        "packet_points",
    ),
)
def generic_points(t):
    rows = P.event_points(t.decoded().where(F.col("payload_kind").startswith("portnum:"))).drop("tags")
    return rows.where(~F.col("field").isin("packet_id", "timestamp_quality"))


@query(
    "p09_builder_counts",
    with_views(
        """SELECT builder, count(*) AS packets FROM (
          SELECT CASE WHEN payload_kind IN ('portnum:1', 'portnum:5') THEN 'skip' WHEN payload_kind LIKE 'telemetry%' THEN 'telemetry'
                      WHEN payload_kind IN ('position', 'nodeinfo') THEN payload_kind ELSE 'generic' END AS builder FROM dec)
        GROUP BY builder""",
        "dec",
    ),
)
def builder_counts(t):
    return t.decoded().groupBy(P.builder(F.col("payload_kind")).alias("builder")).agg(F.count(F.lit(1)).alias("packets"))


@query(
    "p10_numeric_leaves",
    with_views("SELECT node_id, packet_id, leaf AS field, round(value, 6) AS value FROM leaves", "leaves"),
)
def numeric_leaves(t):
    return K.observations(t.decoded()).select("node_id", "packet_id", "field", "value")


@query(
    "p11_channels_in_payload",
    with_views(
        """SELECT node_id, packet_id,
               COALESCE(top, CASE WHEN payload_kind LIKE '%:%' THEN substr(payload_kind, strpos(payload_kind, ':') + 1)
                                  ELSE payload_kind END) || '.' || leaf AS channel, round(value, 6) AS value
        FROM leaves WHERE top IS NOT NULL OR leaf <> 'time'""",
        "leaves",
    ),
)
def channels_in_payload(t):
    return K.channels_in(t.decoded()).select("node_id", "packet_id", "channel", "value")


_KINDS = """SELECT *, CASE o_orderstatus WHEN 'F' THEN 'derived' WHEN 'O' THEN 'telemetry:' || lower(o_orderpriority)
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'quality' WHEN o_orderkey % 3 = 1 THEN 'a:b:c' END END AS kind FROM orders"""


def _kinds(t):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey") % 3
    kind = (
        F.when(status == "F", "derived")
        .when(status == "O", F.concat(F.lit("telemetry:"), F.lower("o_orderpriority")))
        .when(key == 0, "quality")
        .when(key == 1, "a:b:c")
    )
    return t.raw("orders").withColumn("kind", kind)


@query(
    "p12_p13_channel_names",
    with_views(
        """SELECT o_orderkey, CASE WHEN kind IS NULL THEN 'unknown' WHEN strpos(kind, ':') > 0 THEN substr(kind, strpos(kind, ':') + 1)
                 ELSE kind END || '.value' AS channel,
               split_part(COALESCE(kind, ''), ':', 1) AS namespace,
               CASE split_part(COALESCE(kind, ''), ':', 1) WHEN 'telemetry' THEN 'measured' WHEN 'derived' THEN 'derived'
                 WHEN 'quality' THEN 'quality' ELSE 'other' END AS origin,
               CASE WHEN kind IN ('derived', 'quality') THEN kind ELSE 'measured' END AS measurement_origin
        FROM kinds""",
        kinds=_KINDS,
    ),
)
def channel_names(t):
    kind = F.col("kind")
    return _kinds(t).select(
        "o_orderkey",
        C.channel_name(kind, F.lit("value")).alias("channel"),
        C.namespace_of(kind).alias("namespace"),
        C.origin_of(kind).alias("origin"),
        C.origin_of_measurement(kind).alias("measurement_origin"),
    )


@query(
    "p15_sightings",
    with_views(
        f"""SELECT mesh_id || ':' || node_id AS key, mesh_id, node_id AS device_id,
          CASE WHEN located THEN round(lat / 1e7, 6) END AS latitude, CASE WHEN located THEN round(lon / 1e7, 6) END AS longitude,
          CASE WHEN info THEN NULLIF(json_extract_string(payload, '$.long_name'), '') END AS name,
          CASE WHEN info THEN NULLIF(json_extract_string(payload, '$.short_name'), '') END AS short_name,
          CASE WHEN info THEN NULLIF(json_extract_string(payload, '$.hw_model'), '') END AS hardware_type,
          CASE WHEN info THEN NULLIF(json_extract_string(payload, '$.role'), '') END AS role,
          {stamp('make_timestamp(rx_time * 1000000)')} AS seen_at, 'upsert' AS op
        FROM (SELECT *, payload_kind = 'nodeinfo' AS info, payload_kind = 'position' AND lat IS NOT NULL AND lon IS NOT NULL AS located
          FROM (SELECT *, CAST(json_extract(payload, '$.latitude_i') AS DOUBLE) AS lat,
                  CAST(json_extract(payload, '$.longitude_i') AS DOUBLE) AS lon FROM dec WHERE mesh_id IS NOT NULL))""",
        "dec",
    ),
)
def sightings(t):
    return K.sightings(t.decoded())


@query(
    "p16_discoveries",
    with_views(
        """SELECT mesh_id, node_id AS device_id, payload_kind, f.key AS field, rx_time
        FROM dec d, json_each(json_extract(d.payload, '$.' || NULLIF(substr(payload_kind, 11), ''))) f
        WHERE mesh_id IS NOT NULL AND payload_kind LIKE 'telemetry:%' AND f.type IN ('UBIGINT', 'BIGINT', 'DOUBLE')""",
        "dec",
    ),
)
def discoveries(t):
    return K.discoveries(t.decoded()).select(
        "mesh_id", "device_id", "payload_kind", F.explode("fields").alias("field"), F.unix_seconds("seen_at").alias("rx_time")
    )


_UNITS = sorted(KIND_BY_UNIT)
_UNIT_ROWS = ", ".join(f"('{u}', '{KIND_BY_UNIT[u]}', {i})" for i, u in enumerate(_UNITS))


@query(
    "p17_quantity_kinds",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, u.unit, u.kind AS quantity_kind FROM lineitem
    LEFT JOIN (VALUES {_UNIT_ROWS}) u(unit, kind, i) ON u.i = l_orderkey % {len(_UNITS) + 1}""",
)
def quantity_kinds(t):
    units = F.array(*[F.lit(u) for u in _UNITS])
    unit = F.get(units, (F.col("l_orderkey") % (len(_UNITS) + 1)).cast("int"))
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", unit.alias("unit"))
    return rows.withColumn("quantity_kind", quantity_kind(F.col("unit")))


@query(
    "p18_split_channels",
    """SELECT c_custkey, CASE WHEN ok THEN split_part(channel, '.', 1) END AS measurement,
           CASE WHEN ok THEN substr(channel, strpos(channel, '.') + 1) END AS field
    FROM (SELECT *, regexp_full_match(channel, '[A-Za-z0-9_:\\-]+\\.[A-Za-z0-9_:.\\-]+') AS ok
      FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || '.' || c_custkey
              WHEN 2 THEN 'a.' || c_custkey || '.b' WHEN 3 THEN '.' || c_custkey ELSE 'a b.' || c_custkey END AS channel FROM customer))""",
)
def split_channels(t):
    key = F.col("c_custkey")
    dot = F.lit(".")
    channel = (
        F.when(key % 5 == 0, F.col("c_name"))
        .when(key % 5 == 1, F.concat("c_mktsegment", dot, key))
        .when(key % 5 == 2, F.concat(F.lit("a."), key, F.lit(".b")))
        .when(key % 5 == 3, F.concat(dot, key))
        .otherwise(F.concat(F.lit("a b."), key))
    )
    parts = C.split_channel(channel)
    return t.raw("customer").select(
        "c_custkey", parts["measurement"].alias("measurement"), parts["field"].alias("field")
    )


@query(
    "p25_keys",
    "SELECT c_custkey, printf('!%08x', c_custkey) AS gateway_key, 'mesh-' || c_nationkey || ':' || c_custkey AS node_key FROM customer",
)
def keys(t):
    return t.devices().select(
        F.col("device_id").alias("c_custkey"),
        C.gateway_key(F.col("device_id")).alias("gateway_key"),
        C.node_key(F.col("mesh_id"), F.col("device_id")).alias("node_key"),
    )
