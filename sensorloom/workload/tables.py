"""Views of the given star-schema tables as telemetry tables.

`events` are readings, `customer` the devices, `nation` the meshes, `region`
their owners and `orders` a changelog. Each view is a DataFrame over the whole
table; `sql_views` states the same views as SQL for the oracle.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session
from ..functions.channels import gateway_key
from ..operators import packets
from ..operators.recipes import hinted

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TELEMETRY = ("click", "purchase", "view")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = session.prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- readings ---------------------------------------------------------

    def events(self) -> DataFrame:
        return self.shape_events(self.raw("events"))

    @staticmethod
    def shape_events(raw: DataFrame) -> DataFrame:
        return raw.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("time"),
            "user_id",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    def mesh_of_node(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("mesh-"), "c_nationkey").alias("mesh_id"),
        )

    def points(self, fields: tuple[str, ...] = ("value", "k"), hints: tuple[str, ...] = ()) -> DataFrame:
        """Long points; `fields` decides what is read and spread, `hints` how
        devices are joined."""
        entry = {
            "value": lambda: F.struct(
                F.lit("value").alias("field"), F.col("value"), F.lit("double").alias("value_type")
            ),
            "k": lambda: F.struct(
                F.lit("k").alias("field"), F.col("k").cast("double").alias("value"), F.lit("long").alias("value_type")
            ),
        }
        entries = [entry[name]() for name in fields]
        spread = F.inline(F.array(*entries)) if len(entries) > 1 else None
        rows = self.events().join(hinted(self.mesh_of_node(), hints), "user_id")
        head = (
            F.col("mesh_id"),
            F.col("user_id").alias("node_id"),
            F.col("event_type").alias("measurement"),
            F.col("time"),
            F.col("event_id").alias("packet_id"),
        )
        if spread is not None:
            rows = rows.select(*head, spread)
        else:
            rows = rows.select(
                *head,
                F.lit(fields[0]).alias("field"),
                F.col(fields[0]).cast("double").alias("value"),
                F.lit("double" if fields[0] == "value" else "long").alias("value_type"),
            )
        return rows.withColumn("channel", F.concat_ws(".", "measurement", "field"))

    def coarse(self) -> DataFrame:
        """Readings in steps of 50, which repeat often enough to be flat."""
        return self.points(("value",)).withColumn("value", F.floor(F.col("value") / 50).cast("double"))

    # --- registry ---------------------------------------------------------

    def devices(self) -> DataFrame:
        key = F.col("c_custkey")
        none = lambda kind: F.lit(None).cast(kind)
        return self.raw("customer").select(
            F.concat(F.lit("dev-"), key).alias("id"),
            key.alias("device_id"),
            F.concat(F.lit("mesh-"), "c_nationkey").alias("mesh_id"),
            F.when(key % 4 == 0, F.concat(F.lit("sensor "), key)).alias("label"),
            (key % 10 == 9).alias("is_gateway"),
            (key % 11 != 0).alias("is_allowed"),
            F.when(key % 2 == 0, "bp-1").when(key % 5 == 0, "bp-2").alias("postprocessing_blueprint_id"),
            F.when(key % 3 != 0, 172800).alias("reading_interval_seconds"),
            F.when(key % 13 != 12, 43200).alias("publish_interval_seconds"),
            none("double").alias("latitude"),
            none("double").alias("longitude"),
            (key % 7 == 0).alias("location_overridden"),
            F.col("c_name").alias("name"),
            none("string").alias("short_name"),
            none("string").alias("hardware_type"),
            F.col("c_mktsegment").alias("role"),
            (key % 5 == 0).alias("nodeinfo_overridden"),
            none("timestamp").alias("last_seen"),
        )

    def meshes(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("mesh-"), "n_nationkey").alias("mesh_id"),
            F.concat(F.lit("ch-"), "n_nationkey").alias("channel_id"),
            F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("label"),
            F.concat(F.lit("owner-"), "n_regionkey").alias("owner_id"),
            F.concat(F.lit("secret-"), "n_nationkey").alias("mesh_key"),
        )

    def owners(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.raw("region").select(
            F.concat(F.lit("owner-"), key).alias("owner_id"),
            F.col("r_name").alias("name"),
            F.when(key != 3, F.concat(F.lower("r_name"), F.lit("@example.org"))).alias("email"),
            (key != 4).alias("is_active"),
        )

    def gateways(self) -> DataFrame:
        """Registered gateways: even nations; one of them without a mesh."""
        key = F.col("n_nationkey")
        return self.raw("nation").where(key % 2 == 0).select(
            gateway_key(key.cast("long")).alias("gateway_id"),
            F.when(key != 10, F.concat(F.lit("mesh-"), key)).alias("mesh_id"),
        )

    def rejections(self) -> DataFrame:
        return self.devices().where(~F.col("is_allowed")).select("mesh_id", "device_id")

    # --- packets ----------------------------------------------------------

    def envelopes(self) -> DataFrame:
        return self.shape_envelopes(self.shape_events(self.raw("events")), self.raw("customer"))

    @staticmethod
    def shape_envelopes(events: DataFrame, customer: DataFrame) -> DataFrame:
        k, seconds = F.col("k"), F.unix_seconds("time")
        kind = F.col("event_type")
        port = (
            F.when(kind.isin(*TELEMETRY), 67)
            .when(kind == "signup", F.when(k % 2 == 0, 4).otherwise(1))
            .when(k % 4 <= 1, 3)
            .when(k % 4 == 2, 99)
            .otherwise(80)
        )
        clock = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.lit(1000)).otherwise(seconds - 30)
        flag = F.when(k % 2 == 0, "true").otherwise("false")
        text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
        extra = F.when(
            kind == "purchase", text(', "extra": {"basket": ', k, ', "deep": {"level": ', k, "}}")
        ).otherwise("")
        telemetry = text(
            '{"time": ', clock, ', "uptime": ', k, ', "', kind, '": {"value": ', F.col("value"), ', "k": ', k,
            ', "seq": "', F.col("event_id"), '", "ok": ', flag, "}", extra, "}",
        )
        nodeinfo = text(
            '{"id": "', gateway_key(F.col("user_id")), '", "long_name": "', F.col("c_name"), '", "short_name": "',
            F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("S"), k)), '", "hw_model": "MODEL_', k % 4, '", "role": "',
            F.col("c_mktsegment"), '"}',
        )
        position = text(
            '{"latitude_i": ', k * 1000000 + F.col("event_id") * 10,
            F.when(k % 9 != 0, text(', "longitude_i": ', -k * 2000000)).otherwise(""),
            F.when(k % 5 != 0, text(', "altitude": ', k)).otherwise(""), "}",
        )
        generic = text(
            '{"metric": ', F.col("value"), ', "count": ', k, ', "ok": ', flag, ', "note": "x", "inner": {"a": 1}}'
        )
        payload = (
            F.when(port == 67, telemetry)
            .when(port == 4, nodeinfo)
            .when(port == 1, '{"text": "hello"}')
            .when(port == 3, position)
            .when(port == 99, generic)
        )
        return events.join(customer, events["user_id"] == customer["c_custkey"]).select(
            gateway_key(F.col("c_nationkey").cast("long")).alias("gateway_id"),
            F.when(k % 13 == 0, "").otherwise("primary").alias("channel_id"),
            F.col("user_id").alias("node_id"),
            F.col("event_id").alias("packet_id"),
            seconds.alias("rx_time"),
            (k % 8).cast("int").alias("hop_start"),
            port.alias("portnum"),
            F.when(port == 67, kind).alias("variant"),
            payload.alias("payload"),
            (k % 17 != 0).alias("decryptable"),
        )

    def gated(self) -> DataFrame:
        return packets.gate(self.envelopes(), self.gateways(), self.rejections())

    def decoded(self) -> DataFrame:
        return packets.decoded(self.gated())

    # --- catalog ----------------------------------------------------------

    def kinds(self) -> DataFrame:
        """The telemetry kinds that occur in the events."""
        return self.raw("events").select("event_type").distinct()

    def types(self) -> DataFrame:
        entries = F.array(
            F.struct(F.lit("value").alias("field_name"), F.lit("degC").alias("native_unit")),
            F.struct(F.lit("k").alias("field_name"), F.lit(None).cast("string").alias("native_unit")),
        )
        return self.kinds().select(
            F.concat(F.lit("telemetry:"), "event_type").alias("payload_kind"),
            F.inline(entries),
        ).select(
            "payload_kind",
            "field_name",
            "native_unit",
            F.when(F.col("native_unit").isNotNull(), "physical_property").alias("quantity_kind"),
            F.lit(None).cast("string").alias("vocabulary_uri"),
        )

    def variants(self) -> DataFrame:
        return self.kinds().select(
            F.concat(F.lit("telemetry:"), "event_type").alias("payload_kind"),
            F.when(F.col("event_type") != "signup", 259200).alias("default_reading_interval_seconds"),
        )

    def links(self) -> DataFrame:
        return self.types().where(F.col("field_name") == "value").select(
            "payload_kind", "field_name", F.lit(0.0).alias("valid_min"), F.lit(200.0).alias("valid_max")
        )

    def measurements(self) -> DataFrame:
        """Every device carries the `value` channel of the five kinds."""
        kinds = F.array(*[F.lit(f"telemetry:{n}") for n in ("click", "error", "purchase", "signup", "view")])
        return self.devices().select(
            "mesh_id", "device_id", F.explode(kinds).alias("payload_kind"), F.lit("value").alias("field_name")
        )

    # --- changelogs -------------------------------------------------------

    def changelog(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").cast("string").alias("key"),
            F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"),
            "o_totalprice",
            F.col("o_orderdate").cast("timestamp").alias("changed_at"),
            F.col("o_orderkey").alias("version"),
        )

    def calibration_changes(self) -> DataFrame:
        """One curve per device for its `view.value`, of a kind set by the order."""
        kind = F.col("o_orderkey") % 4
        params = (
            F.when(kind == 0, '{"scale": 2, "offset": -1}')
            .when(kind == 1, '{"points": [[200, 190], [0, 5], [50, 60]]}')
            .when(kind == 2, '{"scale": null}')
            .otherwise("{}")
        )
        name = F.when(kind.isin(0, 2), "offset_scale").when(kind == 1, "lookup_table").otherwise("unheard_of")
        return self.raw("orders").select(
            F.concat(F.lit("primary:"), "o_custkey", F.lit(":telemetry:view:value")).alias("key"),
            F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"),
            name.alias("function_name"),
            params.alias("params"),
            F.col("o_orderkey").alias("version"),
        )

    def rule_changes(self) -> DataFrame:
        even = F.col("o_orderkey") % 2 == 0
        return self.raw("orders").select(
            F.concat("o_custkey", F.lit(":value")).alias("key"),
            F.when(F.col("o_orderstatus") == "F", "delete").alias("op"),
            F.when(F.col("o_orderkey") % 7 == 0, "other_detector").otherwise("range_check").alias("detector_name"),
            F.when(even, '{"min": 1, "max": 120}').otherwise('{"max": 80}').alias("params"),
            F.col("o_orderkey").alias("version"),
        )

    # Weeks in which a change of the year's quarters reaches a stream of January.
    CHANGE_WEEK = "least(floor((month(o_orderdate) - 1) / 3), 3)"

    def _weekly_changes(self) -> DataFrame:
        week = F.expr(self.CHANGE_WEEK).cast("long")
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            "*",
            week.alias("week"),
            (F.shiftleft(week, 40) + F.col("o_orderkey")).alias("version"),
            F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"),
        )

    def weekly_config(self) -> DataFrame:
        """A merged feed of gateways and rejections, with the week of each change."""
        urgent = F.col("o_orderpriority") == "1-URGENT"
        mesh = F.concat(F.lit("mesh-"), "c_nationkey")
        return self._weekly_changes().select(
            F.when(urgent, "gateway_key").otherwise("node_rejection").alias("kind"),
            F.when(urgent, gateway_key(F.col("c_nationkey").cast("long"))).otherwise(F.concat_ws(":", mesh, "c_custkey")).alias("key"),
            mesh.alias("mesh_id"),
            F.when(~urgent, F.col("c_custkey")).alias("device_id"),
            "op",
            "version",
            "week",
        )

    def weekly_rules(self) -> DataFrame:
        even = F.col("o_orderkey") % 2 == 0
        return self._weekly_changes().select(
            F.concat("o_custkey", F.lit(":value")).alias("key"),
            "op",
            F.lit("range_check").alias("detector_name"),
            F.when(even, '{"min": 60, "max": 120}').otherwise('{"max": 80}').alias("params"),
            "version",
            "week",
        )


# --- the same views for the oracle -----------------------------------------

_PORT = (
    "CASE WHEN event_type IN ('click','purchase','view') THEN 67 "
    "WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END "
    "WHEN k % 4 <= 1 THEN 3 WHEN k % 4 = 2 THEN 99 ELSE 80 END"
)

SQL_VIEWS = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(floor(epoch(ts)) AS BIGINT) AS es
        FROM events""",
    "pts": """
        SELECT 'mesh-' || c_nationkey AS mesh_id, user_id AS node_id, event_type AS measurement, field,
               event_type || '.' || field AS channel,
               CASE field WHEN 'value' THEN value ELSE CAST(k AS DOUBLE) END AS value,
               ts AS time, event_id AS packet_id
        FROM ev JOIN customer ON c_custkey = user_id CROSS JOIN (VALUES ('value'), ('k')) f(field)""",
    "vals": "SELECT * FROM pts WHERE field = 'value'",
    "coarse": "SELECT * REPLACE (floor(value / 50) AS value) FROM vals",
    "dev": """
        SELECT 'dev-' || c_custkey AS id, c_custkey AS device_id, 'mesh-' || c_nationkey AS mesh_id,
               CASE WHEN c_custkey % 4 = 0 THEN 'sensor ' || c_custkey END AS label,
               c_custkey % 10 = 9 AS is_gateway, c_custkey % 11 <> 0 AS is_allowed,
               CASE WHEN c_custkey % 2 = 0 THEN 'bp-1' WHEN c_custkey % 5 = 0 THEN 'bp-2' END
                 AS postprocessing_blueprint_id,
               CASE WHEN c_custkey % 3 <> 0 THEN 172800 END AS reading_interval_seconds,
               CASE WHEN c_custkey % 13 <> 12 THEN 43200 END AS publish_interval_seconds,
               c_custkey % 7 = 0 AS location_overridden, c_name AS name, c_mktsegment AS role,
               c_custkey % 5 = 0 AS nodeinfo_overridden
        FROM customer""",
    "mesh": """
        SELECT 'mesh-' || n_nationkey AS mesh_id, 'ch-' || n_nationkey AS channel_id,
               CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS label,
               'owner-' || n_regionkey AS owner_id, 'secret-' || n_nationkey AS mesh_key
        FROM nation""",
    "own": """
        SELECT 'owner-' || r_regionkey AS owner_id, r_name AS name,
               CASE WHEN r_regionkey <> 3 THEN lower(r_name) || '@example.org' END AS email,
               r_regionkey <> 4 AS is_active
        FROM region""",
    "gw": """
        SELECT printf('!%08x', n_nationkey) AS gateway_id,
               CASE WHEN n_nationkey <> 10 THEN 'mesh-' || n_nationkey END AS mesh_id
        FROM nation WHERE n_nationkey % 2 = 0""",
    "rej": "SELECT mesh_id, device_id FROM dev WHERE NOT is_allowed",
    "env": f"""
        SELECT printf('!%08x', c_nationkey) AS gateway_id,
               CASE WHEN k % 13 = 0 THEN '' ELSE 'primary' END AS channel_id,
               user_id AS node_id, event_id AS packet_id, es AS rx_time, k % 8 AS hop_start,
               portnum, CASE WHEN portnum = 67 THEN event_type END AS variant,
               CASE portnum
                 WHEN 67 THEN '{{"time": ' || CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE es - 30 END
                   || ', "uptime": ' || k || ', "' || event_type || '": {{"value": ' || value || ', "k": ' || k
                   || ', "seq": "' || event_id || '", "ok": ' || (k % 2 = 0) || '}}'
                   || CASE WHEN event_type = 'purchase'
                        THEN ', "extra": {{"basket": ' || k || ', "deep": {{"level": ' || k || '}}}}' ELSE '' END || '}}'
                 WHEN 4 THEN '{{"id": "' || printf('!%08x', user_id) || '", "long_name": "' || c_name
                   || '", "short_name": "' || CASE WHEN k % 4 = 0 THEN '' ELSE 'S' || k END
                   || '", "hw_model": "MODEL_' || (k % 4) || '", "role": "' || c_mktsegment || '"}}'
                 WHEN 1 THEN '{{"text": "hello"}}'
                 WHEN 3 THEN '{{"latitude_i": ' || (k * 1000000 + event_id * 10)
                   || CASE WHEN k % 9 <> 0 THEN ', "longitude_i": ' || (-k * 2000000) ELSE '' END
                   || CASE WHEN k % 5 <> 0 THEN ', "altitude": ' || k ELSE '' END || '}}'
                 WHEN 99 THEN '{{"metric": ' || value || ', "count": ' || k || ', "ok": ' || (k % 2 = 0)
                   || ', "note": "x", "inner": {{"a": 1}}}}'
               END AS payload,
               k % 17 <> 0 AS decryptable
        FROM (SELECT *, CAST({_PORT} AS BIGINT) AS portnum FROM ev) JOIN customer ON c_custkey = user_id""",
    "gated": """
        SELECT env.*, gw.mesh_id,
               CASE WHEN gw.gateway_id IS NULL THEN 'unregistered_gateway'
                    WHEN rej.device_id IS NOT NULL THEN 'rejected_node'
                    WHEN NOT decryptable THEN 'undecryptable'
                    WHEN payload IS NULL THEN 'no_schema' END AS drop_reason
        FROM env LEFT JOIN gw USING (gateway_id)
        LEFT JOIN rej ON rej.mesh_id = gw.mesh_id AND rej.device_id = env.node_id""",
    "dec": """
        SELECT node_id, packet_id, portnum, rx_time, hop_start, channel_id, gateway_id, mesh_id,
               CASE portnum WHEN 67 THEN 'telemetry:' || variant WHEN 3 THEN 'position' WHEN 4 THEN 'nodeinfo'
                    ELSE 'portnum:' || portnum END AS payload_kind,
               payload
        FROM gated WHERE drop_reason IS NULL""",
    "typ": """
        SELECT DISTINCT 'telemetry:' || event_type AS payload_kind, field_name, native_unit,
               CASE WHEN native_unit IS NOT NULL THEN 'physical_property' END AS quantity_kind,
               CAST(NULL AS VARCHAR) AS vocabulary_uri
        FROM events CROSS JOIN (VALUES ('value', 'degC'), ('k', NULL)) t(field_name, native_unit)""",
    "var": """
        SELECT DISTINCT 'telemetry:' || event_type AS payload_kind,
               CASE WHEN event_type <> 'signup' THEN 259200 END AS default_reading_interval_seconds
        FROM events""",
    "lnk": """
        SELECT payload_kind, field_name, 0.0 AS valid_min, 200.0 AS valid_max
        FROM typ WHERE field_name = 'value'""",
    "meas": """
        SELECT mesh_id, device_id, 'telemetry:' || kind AS payload_kind, 'value' AS field_name
        FROM dev CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(kind)""",
    # Newest order per customer, by order key.
    "cfg": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
        WHERE rn = 1 AND o_orderstatus <> 'F'""",
    # Changes of configuration as of each week: the newest per key.
    "changes": """
        SELECT *, o_orderpriority = '1-URGENT' AS urgent, least((month(o_orderdate) - 1) // 3, 3) AS week,
               least((month(o_orderdate) - 1) // 3, 3) * 1099511627776 + o_orderkey AS version
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "weeks": "SELECT unnest(range(4)) AS batch",
    "live_gates": """
        SELECT batch, urgent, CASE WHEN urgent THEN c_nationkey ELSE c_custkey END AS id, any_value('mesh-' || c_nationkey) AS mesh_id
        FROM weeks JOIN changes ON week <= batch GROUP BY ALL HAVING arg_max(o_orderstatus, version) <> 'F'""",
    "live_rules": """
        SELECT batch, c_custkey AS node, arg_max(o_orderkey, version) % 2 = 0 AS both_sides
        FROM weeks JOIN changes ON week <= batch GROUP BY ALL HAVING arg_max(o_orderstatus, version) <> 'F'""",
    # Time and its quality for every decoded event (P-02).
    "timed": """
        SELECT *, CASE WHEN trusted THEN 'payload' ELSE 'rx_time' END AS timestamp_quality,
               CASE WHEN trusted THEN clock ELSE rx_time END AS at_s
        FROM (SELECT *, COALESCE(clock > 1577836800, FALSE) AS trusted
              FROM (SELECT *, CAST(json_extract(payload, '$.time') AS BIGINT) AS clock FROM dec))""",
    # Points of the packets before packet_id and timestamp_quality are added:
    # one row per own field, or one with a null field where there is none.
    "own_fields": """
        SELECT t.*, m.key AS measurement, f.key AS field,
               CASE f.type WHEN 'BOOLEAN' THEN CASE WHEN f.value::VARCHAR = 'true' THEN 1.0 ELSE 0.0 END
                           WHEN 'VARCHAR' THEN TRY_CAST(json_extract_string(f.value, '$') AS DOUBLE)
                           ELSE TRY_CAST(f.value AS DOUBLE) END AS value,
               CAST(NULL AS VARCHAR) AS value_str, CAST(NULL AS BOOLEAN) AS value_bool, 'double' AS value_type
        FROM timed t, json_each(t.payload) m, json_each(m.value) f
        WHERE t.payload_kind LIKE 'telemetry%' AND m.key <> 'time' AND m.type = 'OBJECT' AND f.type <> 'OBJECT'
        UNION ALL
        SELECT t.*, 'position', f.field, f.value, NULL, NULL, 'double'
        FROM timed t, LATERAL (
          SELECT 'latitude' AS field, CAST(json_extract(t.payload, '$.latitude_i') AS DOUBLE) / 1e7 AS value
          UNION ALL SELECT 'longitude', CAST(json_extract(t.payload, '$.longitude_i') AS DOUBLE) / 1e7
          UNION ALL SELECT 'altitude', CAST(json_extract(t.payload, '$.altitude') AS DOUBLE)) f
        WHERE t.payload_kind = 'position' AND f.value IS NOT NULL
        UNION ALL
        SELECT t.*, 'nodeinfo', 'user_id', NULL, json_extract_string(payload, '$.id'), NULL, 'string'
        FROM timed t WHERE t.payload_kind = 'nodeinfo'
        UNION ALL
        SELECT t.*, 'portnum_' || portnum, f.key,
               CASE WHEN f.type <> 'BOOLEAN' THEN CAST(f.value AS DOUBLE) END, NULL,
               CASE WHEN f.type = 'BOOLEAN' THEN f.value::VARCHAR = 'true' END,
               CASE f.type WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'double' ELSE 'long' END
        FROM timed t, json_each(t.payload) f
        WHERE t.payload_kind LIKE 'portnum:%' AND t.payload_kind NOT IN ('portnum:1', 'portnum:5')
          AND f.type NOT IN ('VARCHAR', 'OBJECT', 'ARRAY', 'NULL')""",
    "packet_points": """
        SELECT mesh_id, node_id, NULLIF(channel_id, '') AS channel_id, gateway_id, measurement, field, value,
               value_str, value_bool, value_type, packet_id, timestamp_quality, at_s, payload_kind, payload
        FROM own_fields
        UNION ALL
        SELECT DISTINCT mesh_id, node_id, NULLIF(channel_id, ''), gateway_id, measurement, 'packet_id',
               CAST(packet_id AS DOUBLE), NULL, NULL, 'long', packet_id, timestamp_quality, at_s, payload_kind, payload
        FROM own_fields
        UNION ALL
        SELECT DISTINCT mesh_id, node_id, NULLIF(channel_id, ''), gateway_id, measurement, 'timestamp_quality',
               NULL, timestamp_quality, NULL, 'string', packet_id, timestamp_quality, at_s, payload_kind, payload
        FROM own_fields""",
    # Every number in a payload with the key of the member it sits in.
    "leaves": """
        SELECT d.*, CASE WHEN t.path = '$' THEN NULL ELSE split_part(substr(t.fullkey, 3), '.', 1) END AS top,
               t.key AS leaf, CAST(t.value AS DOUBLE) AS value
        FROM dec d, json_tree(d.payload) t
        WHERE t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')""",
}

_NEEDS = {
    "live_gates": ["changes", "weeks"],
    "live_rules": ["changes", "weeks"],
    "pts": ["ev"],
    "vals": ["pts"],
    "coarse": ["vals"],
    "rej": ["dev"],
    "env": ["ev"],
    "gated": ["env", "gw", "rej"],
    "dec": ["gated"],
    "lnk": ["typ"],
    "meas": ["dev"],
    "timed": ["dec"],
    "own_fields": ["timed"],
    "packet_points": ["own_fields"],
    "leaves": ["dec"],
}


def with_views(query: str, *views: str, **more: str) -> str:
    """Oracle query preceded by the views it names and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in ordered]
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query


def stamp(expression: str) -> str:
    """A timestamp as text, the same in both engines."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def portable(df: DataFrame) -> DataFrame:
    """Timestamps as text, doubles to six places, integers as bigint."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "double":
            column = F.round(column, 6)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "date":
            column = column.cast("string")
        out.append(column.alias(name))
    return df.select(*out)
