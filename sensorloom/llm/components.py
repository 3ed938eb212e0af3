"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that occurs in a link.

    Each round every vertex points to its smallest neighbour, chains of pointers are halved until they
    end at roots, and the links are rewritten between roots. All steps are aggregates with a map-side
    part or joins whose hot side the engine may split, so a vertex with a third of all links is no
    single task. Null ends and loops are left out; repeated links count once.
    """
    pair = (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = stage(links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(*pair).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("id"), F.col("a").alias("other"))
        )
        parents = both.groupBy("id").agg(F.min("other").alias("low")).select("id", F.least("id", "low").alias("root"))
        parents = stage(parents, "parents")
        while True:
            nodes = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
            twice = parents.join(nodes, "root").select("id", "root", "next")
            far = twice.join(nodes.select(F.col("root").alias("next"), F.col("next").alias("last")), "next")
            jumped = stage(far.select("id", F.col("last").alias("root"), (F.col("last") != F.col("root")).alias("moved")), "parents")
            parents = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents.withColumnRenamed("root", "component")
        else:
            step = parents.select(F.col("id").alias("component"), F.col("root").alias("next"))
            labels = labels.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            labels = stage(labels, "labels")
        ends = parents.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        edges = edges.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = stage(edges.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones, one per vertex at most."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        low = low[root]
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]
