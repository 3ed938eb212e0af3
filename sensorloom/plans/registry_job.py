"""Sightings and discoveries folded into stored registry tables.

The tables are kept in buckets by device number, so a batch rewrites the
buckets of the devices in it. A run that fails leaves the last version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import registry
from ..sources.buckets import BUCKETS, BucketTable

_KEYS = "mesh_id string, device_id long, payload_kind string"
_SEEN = "first_seen timestamp, last_seen timestamp"


def device_table(root: str, schema: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(f"{root}/devices", schema, buckets=buckets)


def variant_table(root: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(f"{root}/device_variants", f"{_KEYS}, {_SEEN}", buckets=buckets)


def measurement_table(root: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(f"{root}/measurements", f"{_KEYS}, field_name string, {_SEEN}", buckets=buckets)


def apply_sightings(devices: BucketTable, sightings: DataFrame, meshes: DataFrame) -> int:
    """A-10, S-11: the devices table after a batch of sightings. All devices of
    a number share a bucket, so the rule on allowed numbers sees them all."""
    known = registry.known_sightings(sightings, meshes)
    return devices.advance(known.select("device_id"), lambda rows: registry.upsert_devices(rows, sightings, meshes))


def apply_discoveries(variants: BucketTable, measurements: BucketTable, discoveries: DataFrame, devices: DataFrame) -> None:
    """A-11: variants and channels of devices after a batch of discoveries."""
    keys = registry.known_discoveries(discoveries, devices).select("device_id")
    variants.advance(keys, lambda rows: registry.upsert_device_variants(rows, discoveries, devices))
    measurements.advance(keys, lambda rows: registry.upsert_measurements(rows, discoveries, devices))


def start_empty(spark: SparkSession, table: BucketTable, rows: DataFrame | None = None) -> None:
    """Version 0 of a table."""
    table.start(spark.createDataFrame([], table.schema) if rows is None else rows)
