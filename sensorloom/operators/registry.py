"""The device registry and the measurement catalog as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.channels import channel_name, node_key, origin_of, origin_of_measurement
from ..functions.units import QUALITY_FIELD_UNITS, quantity_kind

IDENTITY = ("name", "short_name", "hardware_type", "role")

# What the subject of a notification says, by detector.
SUBJECTS = {
    "absence": "Device has stopped publishing",
    "completeness": "Device readings have gaps",
    "flat_value": "Sensor value is flat",
    "plausibility": "Sensor value is out of range",
}
SUBJECT_OTHER = "Data quality alarm"


# --- upserts ---------------------------------------------------------------


def _newest(value: Column, order: Column) -> Column:
    """Latest value that is not null."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def known_sightings(sightings: DataFrame, meshes: DataFrame) -> DataFrame:
    """J-08: upsert sightings of meshes that exist."""
    return sightings.where(F.col("op") == "upsert").join(
        meshes.select("mesh_id").distinct(), "mesh_id"
    )


def fold_sightings(sightings: DataFrame) -> DataFrame:
    """One row per sighted device with the newest value of each attribute."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    place = F.when(located, F.struct("latitude", "longitude"))
    return (
        sightings.groupBy("mesh_id", "device_id")
        .agg(
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("seen_at"),
            _newest(place, F.struct("seen_at", place)).alias("_place"),
            *[_newest(F.col(c), F.struct("seen_at", c)).alias(f"_{c}") for c in IDENTITY],
        )
    )


def upsert_devices(devices: DataFrame, sightings: DataFrame, meshes: DataFrame) -> DataFrame:
    """A-10: the device table after a set of sightings, as a new snapshot.

    Unknown devices of known meshes become allowed nodes, unless their number
    is already allowed elsewhere; of several meshes that bring the same new
    number, the first sighted gets it. Pinned locations and identities stay.
    """
    seen = fold_sightings(known_sightings(sightings, meshes))
    current = devices.alias("d")
    both = seen.alias("s").join(
        current,
        (F.col("s.mesh_id") == F.col("d.mesh_id")) & (F.col("s.device_id") == F.col("d.device_id")),
        "full_outer",
    )
    pinned_place = F.coalesce("d.location_overridden", F.lit(False))
    pinned_name = F.coalesce("d.nodeinfo_overridden", F.lit(False))
    fresh = F.col("d.device_id").isNull()

    def merged(name: str) -> Column:
        old = F.col(f"d.{name}")
        if name in ("latitude", "longitude"):
            return F.when(pinned_place, old).otherwise(F.coalesce(F.col("s._place")[name], old))
        if name in IDENTITY:
            return F.when(pinned_name, old).otherwise(F.coalesce(F.col(f"s._{name}"), old))
        return {
            "id": lambda: F.coalesce(old, node_key(F.col("s.mesh_id"), F.col("s.device_id"))),
            "mesh_id": lambda: F.coalesce(old, F.col("s.mesh_id")),
            "device_id": lambda: F.coalesce(old, F.col("s.device_id")),
            "is_allowed": lambda: F.when(fresh, True).otherwise(old),
            "is_gateway": lambda: F.when(fresh, False).otherwise(old),
            "location_overridden": lambda: F.coalesce(old, F.lit(False)),
            "nodeinfo_overridden": lambda: F.coalesce(old, F.lit(False)),
            "last_seen": lambda: F.coalesce(F.col("s.seen_at"), old),
        }.get(name, lambda: old)()

    rows = both.select(
        *[merged(name).alias(name) for name in devices.columns],
        fresh.alias("_fresh"),
        F.col("s.first_seen").alias("_first_seen"),
    )
    # A number is that of a few devices at most, one per mesh.
    same_number = Window.partitionBy("device_id")
    taken = F.max(~F.col("_fresh") & F.coalesce("is_allowed", F.lit(False))).over(same_number)
    first = F.min(F.when(F.col("_fresh"), F.struct("_first_seen", "mesh_id"))).over(same_number)
    placed = rows.withColumn("_taken", taken).withColumn("_first", first)
    kept = ~F.col("_fresh") | (~F.col("_taken") & (F.col("_first.mesh_id") == F.col("mesh_id")))
    return placed.where(kept).select(*devices.columns)


def known_discoveries(discoveries: DataFrame, devices: DataFrame) -> DataFrame:
    """J-09: upsert discoveries of registered devices."""
    return discoveries.where(F.col("op") == "upsert").join(
        devices.select("mesh_id", "device_id").distinct(), ["mesh_id", "device_id"]
    )


def _spread(known: DataFrame) -> DataFrame:
    return known.select(
        "mesh_id",
        "device_id",
        "payload_kind",
        "seen_at",
        F.explode("fields").alias("field_name"),
        "field_units",
    )


def _merge_seen(current: DataFrame | None, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the first first_seen and the last last_seen of both tables."""
    both = found if current is None else current.select(*keys, "first_seen", "last_seen").unionByName(found)
    return both.groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def upsert_device_variants(
    current: DataFrame | None, discoveries: DataFrame, devices: DataFrame
) -> DataFrame:
    """A-11: variants each device has reported."""
    found = known_discoveries(discoveries, devices).select(
        "mesh_id", "device_id", "payload_kind", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen")
    )
    return _merge_seen(current, found, ["mesh_id", "device_id", "payload_kind"])


def upsert_measurements(
    current: DataFrame | None, discoveries: DataFrame, devices: DataFrame
) -> DataFrame:
    """A-11: channels each device has reported."""
    found = _spread(known_discoveries(discoveries, devices)).select(
        "mesh_id",
        "device_id",
        "payload_kind",
        "field_name",
        F.col("seen_at").alias("first_seen"),
        F.col("seen_at").alias("last_seen"),
    )
    return _merge_seen(current, found, ["mesh_id", "device_id", "payload_kind", "field_name"])


def upsert_measurement_types(
    current: DataFrame, discoveries: DataFrame, devices: DataFrame
) -> DataFrame:
    """A-11: measurement types; a unit is filled in once and never replaced,
    and a kind is derived from it where none was set."""
    unit = F.nullif(F.try_element_at("field_units", F.col("field_name")), F.lit(""))
    found = (
        _spread(known_discoveries(discoveries, devices))
        .withColumn("_unit", unit)
        .groupBy("payload_kind", "field_name")
        .agg(
            F.min_by("_unit", F.when(F.col("_unit").isNotNull(), F.struct("seen_at", "_unit"))).alias("_unit")
        )
    )
    merged = current.join(found, ["payload_kind", "field_name"], "full_outer")
    old = F.nullif("native_unit", F.lit(""))
    filled = old.isNull() & F.col("_unit").isNotNull()
    columns = {
        "native_unit": F.coalesce(old, F.col("_unit")),
        "quantity_kind": F.when(
            filled, F.coalesce(F.nullif("quantity_kind", F.lit("")), quantity_kind(F.col("_unit")))
        ).otherwise(F.col("quantity_kind")),
    }
    return merged.select(*[columns.get(c, F.col(c)).alias(c) for c in current.columns])


def seed_catalog(fields: DataFrame) -> DataFrame:
    """S-11: measurement types from a description of the telemetry messages.

    `fields` has (variant, field_name, field_type). Text and message fields
    are no channels; the four data-quality channels are added.
    """
    measured = (
        fields.where(~F.lower("field_type").isin("string", "message"))
        .select(F.concat(F.lit("telemetry:"), "variant").alias("payload_kind"), "field_name")
        .distinct()
        .select("*", F.lit(None).cast("string").alias("native_unit"), F.lit(None).cast("string").alias("quantity_kind"))
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("field_name"), F.lit(u).alias("native_unit")) for n, u in QUALITY_FIELD_UNITS.items()]
    )
    quality = (
        fields.sparkSession.range(1)
        .select(F.lit("quality").alias("payload_kind"), F.inline(entries))
        .withColumn("quantity_kind", quantity_kind(F.col("native_unit")))
    )
    return measured.unionByName(quality)


# --- lookups ---------------------------------------------------------------


def device_channels(measurements: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """J-13: channels of devices with unit, limits, channel name and origin."""
    return (
        measurements.join(types, ["payload_kind", "field_name"])
        .join(
            links.select("payload_kind", "field_name", "valid_min", "valid_max"),
            ["payload_kind", "field_name"],
            "left",
        )
        .withColumn("channel", channel_name(F.col("payload_kind"), F.col("field_name")))
        .withColumn("origin", origin_of(F.col("payload_kind")))
    )


def channel_config(links: DataFrame, types: DataFrame, variants: DataFrame) -> DataFrame:
    """J-14: limits and default interval per channel."""
    return (
        links.join(types.select("payload_kind", "field_name"), ["payload_kind", "field_name"])
        .join(variants.select("payload_kind", "default_reading_interval_seconds"), "payload_kind")
        .select(
            channel_name(F.col("payload_kind"), F.col("field_name")).alias("channel"),
            "payload_kind",
            "field_name",
            "valid_min",
            "valid_max",
            "default_reading_interval_seconds",
        )
    )


def describe_readings(readings: DataFrame, types: DataFrame) -> DataFrame:
    """J-11, P-26: latest readings with unit, kind, vocabulary and origin.

    The catalog is keyed by channel; kinds that lead to one channel name are
    reduced to one row first, so no reading is doubled.
    """
    catalog = (
        types.select(
            channel_name(F.col("payload_kind"), F.col("field_name")).alias("_channel"),
            F.struct("payload_kind", "native_unit", "quantity_kind", "vocabulary_uri").alias("_meta"),
        )
        .groupBy("_channel")
        .agg(F.max("_meta").alias("_meta"))
    )
    name = channel_name(F.col("measurement"), F.col("field"))
    return (
        readings.withColumn("_channel", name)
        .join(catalog, "_channel", "left")
        .select(
            *readings.columns,
            F.col("_meta.native_unit").alias("unit"),
            F.col("_meta.quantity_kind").alias("quantity_kind"),
            F.col("_meta.vocabulary_uri").alias("vocabulary_uri"),
            origin_of_measurement(F.col("measurement")).alias("origin"),
        )
    )


def owned_by(rows: DataFrame, devices: DataFrame, meshes: DataFrame, viewer: str | None) -> DataFrame:
    """J-12: rows of the viewer's own devices; None stands for a superuser."""
    if viewer is None:
        return rows
    mine = devices.join(meshes.where(F.col("owner_id") == viewer).select("mesh_id"), "mesh_id", "left_semi")
    return rows.join(
        mine.select("mesh_id", F.col("device_id").alias("node_id")), ["mesh_id", "node_id"], "left_semi"
    )


def filter_types(
    types: DataFrame, kind: str | None = None, payload_kind: str | None = None, field_name: str | None = None
) -> DataFrame:
    """P-22: `kind` also matches everything in the namespace it names."""
    if kind:
        types = types.where((F.col("payload_kind") == kind) | F.col("payload_kind").startswith(kind + ":"))
    if payload_kind:
        types = types.where(F.col("payload_kind") == payload_kind)
    if field_name:
        types = types.where(F.col("field_name") == field_name)
    return types


def filter_devices(
    devices: DataFrame,
    mesh_id: str | None = None,
    is_gateway: bool | None = None,
    is_allowed: bool | None = None,
    has_postprocessing: bool | None = None,
) -> DataFrame:
    """P-23."""
    if mesh_id:
        devices = devices.where(F.col("mesh_id") == mesh_id)
    for name, wanted in (("is_gateway", is_gateway), ("is_allowed", is_allowed)):
        if wanted is not None:
            devices = devices.where(F.col(name) == wanted)
    if has_postprocessing is not None:
        attached = F.col("postprocessing_blueprint_id").isNotNull()
        devices = devices.where(attached if has_postprocessing else ~attached)
    return devices


def masked(rows: DataFrame, secrets: Iterable[str], viewer: str | None, owner: str = "owner_id") -> DataFrame:
    """P-24: secret columns are shown to the owning viewer only, and are not
    even lifted for a superuser."""
    own = F.lit(False) if viewer is None else F.coalesce(F.col(owner) == viewer, F.lit(False))
    for name in secrets:
        rows = rows.withColumn(name, F.when(own, F.col(name)))
    return rows


def route_alarms(alarms: DataFrame, devices: DataFrame, meshes: DataFrame, owners: DataFrame) -> DataFrame:
    """J-10: alarms that can be delivered, with recipient and subject line."""
    routable = alarms.where(
        (F.coalesce("detector", F.lit("")) != "")
        & (F.coalesce("mesh_id", F.lit("")) != "")
        & F.col("device_id").isNotNull()
    )
    reachable = owners.where(F.col("is_active") & (F.coalesce("email", F.lit("")) != ""))
    names = devices.select(
        "mesh_id",
        "device_id",
        F.coalesce(F.nullif("label", F.lit("")), F.nullif("name", F.lit("")), F.col("device_id").cast("string")).alias(
            "device_label"
        ),
    )
    subject = F
    for detector, text in SUBJECTS.items():
        subject = subject.when(F.col("detector") == detector, text)
    return (
        routable.join(names, ["mesh_id", "device_id"])
        .join(meshes.select("mesh_id", "owner_id", F.coalesce(F.nullif("label", F.lit("")), "channel_id").alias("mesh_label")), "mesh_id")
        .join(reachable.select("owner_id", F.col("name").alias("owner_name"), "email"), "owner_id")
        .withColumn("subject", subject.otherwise(SUBJECT_OTHER))
        .select(*alarms.columns, "owner_id", "owner_name", "email", "device_label", "mesh_label", "subject")
    )


# --- totals ----------------------------------------------------------------


def fleet_totals(owners: DataFrame, meshes: DataFrame, devices: DataFrame) -> DataFrame:
    """A-12: one row. Each table is counted by itself and the one-row results
    are put side by side by summing a union."""
    every = F.count(F.lit(1))
    zero = F.lit(0).cast("long")
    parts = [
        owners.agg(every.alias("owners"), zero.alias("meshes"), zero.alias("devices"), zero.alias("active_gateways")),
        meshes.agg(zero.alias("owners"), every.alias("meshes"), zero.alias("devices"), zero.alias("active_gateways")),
        devices.agg(
            zero.alias("owners"),
            zero.alias("meshes"),
            every.alias("devices"),
            F.count_if(F.col("is_gateway") & F.col("is_allowed")).alias("active_gateways"),
        ),
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .agg(*[F.sum(n).alias(n) for n in ("owners", "meshes", "devices", "active_gateways")])
    )


def scan_summary(devices: DataFrame) -> DataFrame:
    """A-13: what one scan starts, over allowed devices."""
    runs = F.count_if(F.coalesce("postprocessing_blueprint_id", F.lit("")) != "")
    return devices.where("is_allowed").agg(
        F.count(F.lit(1)).alias("devices"),
        runs.alias("blueprint_runs"),
        F.count(F.lit(1)).alias("completeness_runs"),
    )
