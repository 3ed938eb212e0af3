"""Changelogs, the device registry, the catalog and alarm routing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.channels import gateway_key, node_key
from ..operators import changelog as L, packets as K, quality as Q, registry as R
from ..plans import registry_job
from ..schemas import DEVICE
from ..session import shared_folder
from .registry import query
from .tables import AS_OF, stamp, with_views


@query(
    "a09_s02_latest_per_key",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS version, round(o_totalprice, 6) AS o_totalprice,
           {stamp('o_orderdate')} AS changed_at
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn = 1 AND o_orderstatus <> 'F'""",
)
def latest_per_key(t):
    live = L.latest_per_key(t.changelog(), ("key",), ("changed_at", "version"))
    return live.select("key", "version", "o_totalprice", "changed_at")


def _config_feed(t):
    """Gateway and rejection changes made of the orders."""
    orders = t.raw("orders")
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    gateways = orders.select(
        F.lit("gateway_key").alias("kind"),
        gateway_key(F.col("o_custkey")).alias("key"),
        F.concat(F.lit("mesh-"), F.col("o_custkey") % 25).alias("mesh_id"),
        op.alias("op"),
        F.col("o_orderkey").alias("version"),
    )
    rejections = orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.lit("node_rejection").alias("kind"),
        node_key(F.concat(F.lit("mesh-"), F.col("o_custkey") % 25), F.col("o_custkey")).alias("key"),
        F.concat(F.lit("mesh-"), F.col("o_custkey") % 25).alias("mesh_id"),
        F.col("o_custkey").alias("device_id"),
        op.alias("op"),
        F.col("o_orderkey").alias("version"),
    )
    return L.merge_config_feeds(gateways, rejections)


_LAST = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders"


@query(
    "u01_config_feeds",
    f"""SELECT 'gateway_key' AS kind, printf('!%08x', o_custkey) AS key, 'mesh-' || (o_custkey % 25) AS mesh_id
    FROM ({_LAST}) WHERE rn = 1 AND o_orderstatus <> 'F'
    UNION ALL
    SELECT 'node_rejection', 'mesh-' || (o_custkey % 25) || ':' || o_custkey, 'mesh-' || (o_custkey % 25)
    FROM ({_LAST} WHERE o_orderpriority = '1-URGENT') WHERE rn = 1 AND o_orderstatus <> 'F'""",
)
def config_feeds(t):
    feed = _config_feed(t)
    gateways = L.gateways_of(feed).select(F.lit("gateway_key").alias("kind"), F.col("gateway_id").alias("key"), "mesh_id")
    rejected = L.rejections_of(feed).select(
        F.lit("node_rejection").alias("kind"), node_key(F.col("mesh_id"), F.col("device_id")).alias("key"), "mesh_id"
    )
    return gateways.unionByName(rejected)


@query(
    "j08_known_sightings",
    with_views("SELECT packet_id, mesh_id, node_id AS device_id FROM dec WHERE mesh_id IN (SELECT mesh_id FROM mesh WHERE owner_id <> 'owner-2')", "dec", "mesh"),
)
def known_sightings(t):
    events = t.decoded().withColumn("gateway_id", F.col("packet_id").cast("string"))
    seen = K.sightings(events).drop("key")
    ids = events.where(F.col("mesh_id").isNotNull()).select("packet_id", "mesh_id", F.col("node_id").alias("device_id"))
    known = R.known_sightings(seen.select("mesh_id", "device_id", "op").distinct(), t.meshes().where(F.col("owner_id") != "owner-2"))
    return ids.join(known.select("mesh_id", "device_id"), ["mesh_id", "device_id"], "left_semi")


# The registry before the sightings: two thirds of the devices are known.
_KNOWN = "SELECT * FROM dev WHERE device_id % 3 <> 1"


ORACLE_DEVICES = with_views(
    f"""SELECT COALESCE(k.id, s.mesh_id || ':' || s.device_id) AS id, COALESCE(k.mesh_id, s.mesh_id) AS mesh_id,
      COALESCE(k.device_id, s.device_id) AS device_id,
      CASE WHEN k.device_id IS NULL THEN TRUE ELSE k.is_allowed END AS is_allowed,
      CASE WHEN k.device_id IS NULL THEN FALSE ELSE k.is_gateway END AS is_gateway,
      CASE WHEN NOT COALESCE(k.location_overridden, FALSE) THEN round(s.lat / 1e7, 6) END AS latitude,
      CASE WHEN NOT COALESCE(k.location_overridden, FALSE) THEN round(s.lon / 1e7, 6) END AS longitude,
      CASE WHEN COALESCE(k.nodeinfo_overridden, FALSE) THEN k.name ELSE COALESCE(s.name, k.name) END AS name,
      CASE WHEN COALESCE(k.nodeinfo_overridden, FALSE) THEN NULL ELSE s.short_name END AS short_name,
      CASE WHEN COALESCE(k.nodeinfo_overridden, FALSE) THEN NULL ELSE s.hw END AS hardware_type,
      CASE WHEN COALESCE(k.nodeinfo_overridden, FALSE) THEN k.role ELSE COALESCE(s.role, k.role) END AS role,
      {stamp('make_timestamp(s.seen * 1000000)')} AS last_seen
    FROM known k FULL OUTER JOIN seen s ON k.mesh_id = s.mesh_id AND k.device_id = s.device_id""",
    "dec",
    "dev",
    known=_KNOWN,
    facts="""SELECT *, payload_kind = 'nodeinfo' AS info, CAST(json_extract(payload, '$.latitude_i') AS DOUBLE) AS lat,
          CAST(json_extract(payload, '$.longitude_i') AS DOUBLE) AS lon FROM dec WHERE mesh_id IS NOT NULL""",
    seen="""SELECT mesh_id, node_id AS device_id, max(rx_time) AS seen,
          arg_max(lat, rx_time) FILTER (WHERE payload_kind = 'position' AND lat IS NOT NULL AND lon IS NOT NULL) AS lat,
          arg_max(lon, rx_time) FILTER (WHERE payload_kind = 'position' AND lat IS NOT NULL AND lon IS NOT NULL) AS lon,
          arg_max(json_extract_string(payload, '$.long_name'), rx_time) FILTER (WHERE info) AS name,
          arg_max(json_extract_string(payload, '$.short_name'), rx_time) FILTER (WHERE info AND json_extract_string(payload, '$.short_name') <> '') AS short_name,
          arg_max(json_extract_string(payload, '$.hw_model'), rx_time) FILTER (WHERE info) AS hw,
          arg_max(json_extract_string(payload, '$.role'), rx_time) FILTER (WHERE info) AS role
        FROM facts GROUP BY mesh_id, node_id""",
)


@query("a10_device_upsert", ORACLE_DEVICES)
def device_upsert(t):
    known = t.devices().where(F.col("device_id") % 3 != 1)
    merged = R.upsert_devices(known, K.sightings(t.decoded()), t.meshes())
    return merged.select(
        "id", "mesh_id", "device_id", "is_allowed", "is_gateway", "latitude", "longitude", *R.IDENTITY, "last_seen"
    )


@query("a10_s11_registry_job", ORACLE_DEVICES)
def registry_job_devices(t):
    """The same sightings in three batches, each rewriting the buckets it touches."""
    known = t.devices().where(F.col("device_id") % 3 != 1)
    devices = registry_job.device_table(f"{shared_folder(t.spark)}/registry-{uuid4().hex}", DEVICE)
    registry_job.start_empty(t.spark, devices, known.select(*[c.split()[0] for c in DEVICE.split(", ")]))
    sightings = K.sightings(t.decoded())
    day = F.dayofmonth("seen_at")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        registry_job.apply_sightings(devices, sightings.where(part), t.meshes())
    merged = devices.read(t.spark)
    return merged.select(
        "id", "mesh_id", "device_id", "is_allowed", "is_gateway", "latitude", "longitude", *R.IDENTITY, "last_seen"
    )


_SEEN_FIELDS = """SELECT mesh_id, node_id AS device_id, payload_kind, f.key AS field_name, rx_time
    FROM dec d, json_each(json_extract(d.payload, '$.' || NULLIF(substr(payload_kind, 11), ''))) f
    WHERE payload_kind LIKE 'telemetry:%' AND f.type IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      AND (mesh_id, node_id) IN (SELECT mesh_id, device_id FROM known)"""


def _discovery_inputs(t):
    return K.discoveries(t.decoded()), t.devices().where(F.col("device_id") % 3 != 1)


@query(
    "j09_known_discoveries",
    with_views(
        "SELECT mesh_id, device_id, payload_kind, field_name AS field, rx_time FROM spread",
        "dec",
        "dev",
        known=_KNOWN,
        spread=_SEEN_FIELDS,
    ),
)
def known_discoveries(t):
    return R.known_discoveries(*_discovery_inputs(t)).select(
        "mesh_id", "device_id", "payload_kind", F.explode("fields").alias("field"), F.unix_seconds("seen_at").alias("rx_time")
    )


@query(
    "a11_device_variants",
    with_views(
        """SELECT mesh_id, device_id, payload_kind, min(rx_time) AS first_seen, max(rx_time) AS last_seen
        FROM spread GROUP BY mesh_id, device_id, payload_kind""",
        "dec",
        "dev",
        known=_KNOWN,
        spread=_SEEN_FIELDS,
    ),
)
def device_variants(t):
    rows = R.upsert_device_variants(None, *_discovery_inputs(t))
    return rows.withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


@query(
    "a11_measurements",
    with_views(
        """SELECT mesh_id, device_id, payload_kind, field_name, min(rx_time) AS first_seen, max(rx_time) AS last_seen
        FROM spread GROUP BY mesh_id, device_id, payload_kind, field_name""",
        "dec",
        "dev",
        known=_KNOWN,
        spread=_SEEN_FIELDS,
    ),
)
def measurements(t):
    rows = R.upsert_measurements(None, *_discovery_inputs(t))
    return rows.withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


@query(
    "a11_registry_job",
    with_views(
        """SELECT mesh_id, device_id, payload_kind, field_name, min(rx_time) AS first_seen, max(rx_time) AS last_seen
        FROM spread GROUP BY mesh_id, device_id, payload_kind, field_name""",
        "dec",
        "dev",
        known=_KNOWN,
        spread=_SEEN_FIELDS,
    ),
)
def registry_job_measurements(t):
    """The same discoveries in two batches, folded into the stored tables."""
    root = f"{shared_folder(t.spark)}/registry-{uuid4().hex}"
    variants, channels = registry_job.variant_table(root), registry_job.measurement_table(root)
    for table in (variants, channels):
        registry_job.start_empty(t.spark, table)
    discoveries, devices = _discovery_inputs(t)
    for part in (F.dayofmonth("seen_at") <= 15, F.dayofmonth("seen_at") > 15):
        registry_job.apply_discoveries(variants, channels, discoveries.where(part), devices)
    return channels.read(t.spark).withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


@query(
    "a11_measurement_types",
    with_views(
        """SELECT payload_kind, field_name,
          CASE WHEN native_unit IS NOT NULL THEN native_unit ELSE found_unit END AS native_unit,
          CASE WHEN native_unit IS NOT NULL THEN quantity_kind ELSE CASE WHEN found_unit IS NOT NULL THEN 'count' END END AS quantity_kind
        FROM typ FULL OUTER JOIN (SELECT payload_kind, field_name, CASE WHEN field_name = 'k' THEN 'count' END AS found_unit
             FROM spread GROUP BY payload_kind, field_name) f USING (payload_kind, field_name)""",
        "dec",
        "dev",
        "typ",
        known=_KNOWN,
        spread=_SEEN_FIELDS,
    ),
)
def measurement_types(t):
    found, devices = _discovery_inputs(t)
    units = F.create_map(F.lit("k"), F.lit("count"))
    rows = R.upsert_measurement_types(t.types(), found.withColumn("field_units", units), devices)
    return rows.drop("vocabulary_uri")


@query(
    "s11_catalog_seed",
    """SELECT DISTINCT 'telemetry:' || event_type AS payload_kind, field_name, CAST(NULL AS VARCHAR) AS native_unit,
           CAST(NULL AS VARCHAR) AS quantity_kind
    FROM events CROSS JOIN (VALUES ('value'), ('k')) f(field_name)
    UNION ALL SELECT 'quality', * FROM (VALUES ('completeness_ratio', 'ratio', 'ratio'), ('observed', 'count', 'count'),
           ('expected', 'count', 'count'), ('largest_gap_seconds', 's', 'physical_property'))""",
)
def catalog_seed(t):
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("field_name"), F.lit(k).alias("field_type"))
            for n, k in (("value", "float"), ("k", "uint32"), ("note", "string"), ("inner", "message"))
        ]
    )
    fields = t.kinds().select(F.col("event_type").alias("variant"), F.inline(entries))
    return R.seed_catalog(fields)


@query(
    "j13_device_channels",
    with_views(
        """SELECT mesh_id, device_id, payload_kind, field_name, split_part(payload_kind, ':', 2) || '.' || field_name AS channel,
               'measured' AS origin, native_unit, valid_min, valid_max
        FROM meas JOIN typ USING (payload_kind, field_name) LEFT JOIN lnk USING (payload_kind, field_name)""",
        "meas",
        "typ",
        "lnk",
    ).replace("0.0 AS valid_min, 200.0 AS valid_max", "CAST(0 AS DOUBLE) AS valid_min, CAST(200 AS DOUBLE) AS valid_max"),
)
def device_channels(t):
    return R.device_channels(t.measurements(), t.types(), t.links()).select(
        "mesh_id", "device_id", "payload_kind", "field_name", "channel", "origin", "native_unit", "valid_min", "valid_max"
    )


@query(
    "j14_channel_config",
    with_views(
        """SELECT split_part(payload_kind, ':', 2) || '.' || field_name AS channel, payload_kind, field_name,
               CAST(valid_min AS DOUBLE) AS valid_min, CAST(valid_max AS DOUBLE) AS valid_max,
               CAST(default_reading_interval_seconds AS BIGINT) AS default_reading_interval_seconds
        FROM lnk JOIN typ USING (payload_kind, field_name) JOIN var USING (payload_kind)""",
        "lnk",
        "var",
    ),
)
def channel_config(t):
    return R.channel_config(t.links(), t.types(), t.variants())


@query(
    "j07_reading_intervals",
    with_views(
        """SELECT mesh_id, device_id, payload_kind, CAST(COALESCE(NULLIF(reading_interval_seconds, 0), default_reading_interval_seconds) AS BIGINT) AS interval_seconds
        FROM meas JOIN dev USING (mesh_id, device_id) LEFT JOIN var USING (payload_kind)""",
        "meas",
        "var",
    ),
)
def reading_intervals(t):
    interval = Q.reading_interval(F.col("reading_interval_seconds"), F.col("default_reading_interval_seconds"))
    return (
        t.measurements()
        .join(t.devices().select("mesh_id", "device_id", "reading_interval_seconds"), ["mesh_id", "device_id"])
        .join(t.variants(), "payload_kind", "left")
        .select("mesh_id", "device_id", "payload_kind", interval.alias("interval_seconds"))
    )


@query(
    "p22_catalog_filter",
    "SELECT DISTINCT 'telemetry:' || event_type AS payload_kind, 'value' AS field_name FROM events",
)
def catalog_filter(t):
    return R.filter_types(t.types(), kind="telemetry", field_name="value").select("payload_kind", "field_name")


@query(
    "p23_device_filter",
    with_views(
        "SELECT id, mesh_id, device_id FROM dev WHERE is_gateway AND is_allowed AND postprocessing_blueprint_id IS NULL", "dev"
    ),
)
def device_filter(t):
    rows = R.filter_devices(t.devices(), is_gateway=True, is_allowed=True, has_postprocessing=False)
    return rows.select("id", "mesh_id", "device_id")


@query(
    "p24_masked_meshes",
    with_views(
        """SELECT d.device_id, m.mesh_id, m.owner_id, CASE WHEN m.owner_id = 'owner-1' THEN mesh_key END AS mesh_key
        FROM dev d JOIN mesh m USING (mesh_id)""",
        "dev",
        "mesh",
    ),
)
def masked_meshes(t):
    rows = t.devices().select("device_id", "mesh_id").join(t.meshes().drop("label", "channel_id"), "mesh_id")
    return R.masked(rows, ["mesh_key"], "owner-1")


@query(
    "a12_fleet_totals",
    with_views(
        """SELECT (SELECT count(*) FROM own) AS owners, (SELECT count(*) FROM mesh) AS meshes, count(*) AS devices,
               count_if(is_gateway AND is_allowed)::BIGINT AS active_gateways FROM dev""",
        "own",
        "mesh",
        "dev",
    ),
)
def fleet_totals(t):
    return R.fleet_totals(t.owners(), t.meshes(), t.devices())


@query(
    "a13_scan_summary",
    with_views(
        """SELECT count(*) AS devices, count(postprocessing_blueprint_id) AS blueprint_runs, count(*) AS completeness_runs
        FROM dev WHERE is_allowed""",
        "dev",
    ),
)
def scan_summary(t):
    return R.scan_summary(t.devices())
