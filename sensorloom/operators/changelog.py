"""Compacted configuration topics: the latest version of each key (A-09, U-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def newest_per_key(
    changes: DataFrame, key: Sequence[str] = ("key",), version: Sequence[str] = ("version",)
) -> DataFrame:
    """Newest version per key, deletes included.

    Rows without a key are ignored. The newest row is found by aggregation, so
    a key with very many versions is reduced within each task before it is
    shuffled.
    """
    keyed = changes.where(F.col(key[0]).isNotNull())
    if len(key) == 1 and dict(changes.dtypes)[key[0]] == "string":
        keyed = keyed.where(F.col(key[0]) != "")
    others = [name for name in changes.columns if name not in key]
    newest = keyed.groupBy(*key).agg(
        F.max_by(F.struct(*others), F.struct(*version)).alias("_r")
    )
    return newest.select(
        *[F.col(name) if name in key else F.col(f"_r.{name}").alias(name) for name in changes.columns]
    )


def latest_per_key(
    changes: DataFrame,
    key: Sequence[str] = ("key",),
    version: Sequence[str] = ("version",),
    op: str = "op",
) -> DataFrame:
    """Live rows of a changelog: newest version per key unless it is a delete;
    a missing op is an upsert."""
    newest = newest_per_key(changes, key, version)
    return newest.where(F.coalesce(F.col(op), F.lit("upsert")) != "delete")


def merge_config_feeds(gateway_changes: DataFrame, rejection_changes: DataFrame) -> DataFrame:
    """U-01: both configuration feeds as one, told apart by `kind`."""
    return gateway_changes.unionByName(rejection_changes, allowMissingColumns=True)


def gateways_of(config: DataFrame, version: Sequence[str] = ("version",)) -> DataFrame:
    """Registered gateways: the `gateway_key` rows of a merged feed."""
    rows = config.where(F.col("kind") == "gateway_key")
    return latest_per_key(rows, ("key",), version).select(F.col("key").alias("gateway_id"), "mesh_id")


def rejections_of(config: DataFrame, version: Sequence[str] = ("version",)) -> DataFrame:
    rows = config.where(F.col("kind") == "node_rejection")
    return latest_per_key(rows, ("key",), version).select("mesh_id", "device_id")
