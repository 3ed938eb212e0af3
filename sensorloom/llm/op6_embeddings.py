"""Near-duplicate vectors: a small-world graph per shard, audited beams, verified cosines, components."""

from __future__ import annotations

from collections.abc import Iterator, Set

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import opened, removed, scratch, stage, table, work_folder, written
from sensorloom.llm.components import components, forest
from sensorloom.llm.hnsw import Graph, units

COSINE = 0.9
#: Shards at least, and vectors of a shard at most: one task builds and holds a shard's graph.
SHARDS, SHARD_ROWS = 6, 200_000
BEAM, WIDEST = 48, 3_072
#: Vectors whose links are also found by comparing them with all others, and the share to be found.
AUDIT, RECALL = 600, 0.98
#: Vectors of a round the audited ones are drawn from, such rounds at most, and links of a vector that has few.
POOL, ROUNDS, FEW = 6_000, 16, 16


def _usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    # Scaling by the largest part first keeps squares of tiny and huge parts in range.
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return np.einsum("ed,ed->e", x, y) / np.sqrt(np.einsum("ed,ed->e", x, x) * np.einsum("ed,ed->e", y, y))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return units(x / np.abs(x).max(axis=1, keepdims=True))


def _build(classes: DataFrame, folder: str) -> list[tuple[int, str]]:
    """(dimension, path) of each shard's graph, written by the task that builds it."""

    def make(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        raw = _matrix(frame["v"])
        path = f"{folder}/{key[0]}-{key[1]}.npz"
        with written(path) as out:
            out.write(Graph.build(_scaled(raw)).dump(raw=raw, ids=frame["rep"].to_numpy(np.int64), copies=frame["copies"].to_numpy(np.int64)))
        return pd.DataFrame({"dim": [key[0]], "path": [path]})

    rows = classes.groupBy("dim", "shard").applyInPandas(make, "dim int, path string").collect()
    return sorted((r["dim"], r["path"]) for r in rows)


def _all_within(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `Graph.within` gives, from all rows in blocks and without the graph's links."""
    found = []
    for at in range(0, len(q), 512):
        for low in range(0, len(x), 8_192):
            i, j = np.nonzero(q[at : at + 512] @ x[low : low + 8_192].T >= least[at : at + 512, None])
            found.append((i + at, j + low))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _search(rows: DataFrame, shards: list[tuple[int, str]], beam: int, audit: bool = False, exact: Set[str] = frozenset()) -> DataFrame:
    """Ask every shard for every vector of (rep, dim, v, copies, least). (id, links, other): rows with a
    number of links of id, and rows with links 0 that join id and other. A link is counted where the end
    with the smaller id asks, for both ends, so both count the same links; components take what either end
    finds. For the audit: the number of vectors that id's own search finds in the shard with number `other`.
    Shards in `exact` are compared row by row."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, block in frame.groupby("dim"):
                own, raw = block["rep"].to_numpy(np.int64), _matrix(block["v"])
                copies, least = block["copies"].to_numpy(np.int64), block["least"].to_numpy(np.float64)
                q = _scaled(raw)
                for number, (_, path) in ((n, s) for n, s in enumerate(shards) if s[0] == dim):
                    with opened(path) as file:
                        graph, data = Graph.load(file.read())
                    if path in exact:
                        i, at = _all_within(q, graph.x, least - 1e-3)
                        j = graph.order[at]
                    else:
                        i, j = graph.within(q, least - 1e-3, beam)
                    good = np.concatenate([np.empty(0, bool), *(
                        _cosines(raw[i[k : k + 50_000]], data["raw"][j[k : k + 50_000]]) >= least[i[k : k + 50_000]] for k in range(0, len(i), 50_000)
                    )])
                    good &= own[i] != data["ids"][j]
                    i, j = i[good], j[good]
                    if audit:
                        n = np.bincount(i, minlength=len(own))
                        yield pd.DataFrame({"id": own[n > 0], "links": n[n > 0], "other": number})
                        continue
                    a, b = forest(own[i], data["ids"][j])
                    yield pd.DataFrame({"id": a, "links": 0, "other": b})
                    once = own[i] < data["ids"][j]
                    i, j = i[once], j[once]
                    for ids, at, weight in ((own, i, data["copies"][j]), (data["ids"], j, copies[i])):
                        n = np.bincount(at, weights=weight, minlength=len(ids)).astype(np.int64)
                        yield pd.DataFrame({"id": ids[n > 0], "links": n[n > 0], "other": ids[n > 0]})

    return rows.select("rep", "dim", "v", "copies", "least").mapInPandas(ask, "id long, links long, other long")


def _drawn(classes: DataFrame, cosine: float, audit: int) -> DataFrame:
    """`audit` vectors with `least`, the similarity at which theirs are to be found.

    Vectors are taken by their hashes, a pool at a time, and their links counted against all rows, until
    enough have links, all have been taken or ROUNDS pools have; two of three drawn have few links, if there
    are so many. Where pools are left and no vector has a link, links are too rare to audit: then the
    nearest neighbours of the first vectors are to be found, which every vector has."""
    order = [F.xxhash64("rep"), F.col("rep")]
    hashed = classes.withColumns({"__h": order[0]})
    links: dict[int, int] = {}
    best: dict[int, float] = {}
    last = None
    for _ in range(ROUNDS):
        rest = hashed if last is None else hashed.where((F.col("__h") > last[0]) | ((F.col("__h") == last[0]) & (F.col("rep") > last[1])))
        pool = rest.orderBy("__h", "rep").limit(max(POOL, audit)).select("rep", "dim", "v", "__h").collect()
        by_dim: dict[int, list] = {}
        for r in pool:
            by_dim.setdefault(r["dim"], []).append((r["rep"], np.array(r["v"], np.float64)))
        asked = {d: (np.array([r for r, _ in x], np.int64), np.stack([v for _, v in x])) for d, x in by_dim.items()}

        def count(frames: Iterator[pd.DataFrame], asked: dict = asked) -> Iterator[pd.DataFrame]:
            units_of = {d: _scaled(v) for d, (_, v) in asked.items()}
            for frame in frames:
                for dim, block in frame.groupby("dim"):
                    if dim in asked:
                        ids, q, x = asked[dim][0], units_of[dim], _scaled(_matrix(block["v"]))
                        n, top = np.zeros(len(q), np.int64), np.full(len(q), -2.0)
                        for at in range(0, len(x), 1_024):
                            s = q @ x[at : at + 1_024].T
                            s[ids[:, None] == block["rep"].to_numpy(np.int64)[None, at : at + 1_024]] = -2.0
                            n += (s >= cosine).sum(axis=1)
                            top = np.maximum(top, s.max(axis=1))
                        yield pd.DataFrame({"id": ids, "n": n, "best": top.astype(np.float64)})

        found = classes.select("rep", "dim", "v").mapInPandas(count, "id long, n long, best double").groupBy("id")
        for r in found.agg(F.sum("n").alias("n"), F.max("best").alias("best")).collect():
            links[r["id"]], best[r["id"]] = r["n"], r["best"]
        last = (pool[-1]["__h"], pool[-1]["rep"]) if pool else None
        if sum(n > 0 for n in links.values()) >= audit or len(pool) < max(POOL, audit):
            break
    few, many = [r for r, n in links.items() if 0 < n <= FEW], [r for r, n in links.items() if n > FEW]
    reps = few[: max(audit - len(many), audit * 2 // 3)]
    reps += many[: audit - len(reps)]
    least = dict.fromkeys(reps, cosine)
    if not reps and len(pool) >= max(POOL, audit):
        # A little below, for the graphs compare in single precision.
        least = {r: best[r] - 1e-6 for r in list(best)[:audit] if best[r] > -2.0}
    kinds = "rep long, least double"
    return classes.join(F.broadcast(classes.sparkSession.createDataFrame(list(least.items()), kinds)), "rep")  # `audit` rows


def _audited(classes: DataFrame, shards: list[tuple[int, str]], cosine: float, beam: int, audit: int, recall: float) -> tuple[int, frozenset[str]]:
    """The first beam that finds the asked share of the links of a fixed number of vectors, and the shards to
    compare with all rows. Their true links are counted by shard against all rows, a block at a time; what
    a search finds is verified, so counts tell what is missed. The share is to be found of all links, of a
    vector's links on the mean, and on the mean of those with few links, so that no large group speaks for
    the small ones. Where the widest beam fails too, every shard in which a link was missed is compared; an
    error if that falls short as well."""
    chosen = stage(_drawn(classes, cosine, audit), "audit")
    parts = chosen.select("rep", "dim", "v", "least").collect()
    by_dim = {d: [(r["rep"], np.array(r["v"], np.float64), r["least"]) for r in parts if r["dim"] == d] for d in {r["dim"] for r in parts}}
    numbers = {path.rpartition("/")[2].removesuffix(".npz"): n for n, (_, path) in enumerate(shards)}

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (dim, shard), block in frame.groupby(["dim", "shard"]):
                asked = by_dim.get(dim, [])
                if asked:
                    q, raw, ids = np.stack([v for _, v, _ in asked]), _matrix(block["v"]), block["rep"].to_numpy(np.int64)
                    names, least = np.array([r for r, _, _ in asked]), np.array([x for _, _, x in asked])
                    i, j = np.nonzero(_scaled(q) @ _scaled(raw).T >= least[:, None] - 1e-3)
                    good = (_cosines(q[i], raw[j]) >= least[i]) & (names[i] != ids[j]) if len(i) else np.empty(0, bool)
                    n = np.bincount(i[good], minlength=len(names))
                    yield pd.DataFrame({"id": names[n > 0], "other": numbers[f"{dim}-{shard}"], "n": n[n > 0]})

    true = classes.select("rep", "dim", "v", "shard").mapInPandas(compare, "id long, other long, n long").groupBy("id", "other").agg(F.sum("n").alias("n"))
    per_shard = {(r["id"], r["other"]): r["n"] for r in true.collect()}  # `audit` times shards numbers at most
    links: dict[int, int] = {}
    for (r, _), n in per_shard.items():
        links[r] = links.get(r, 0) + n
    few = [r for r, n in links.items() if n <= FEW]
    exact: frozenset[str] = frozenset()
    while links:
        found = _search(chosen, shards, beam, audit=True, exact=exact).groupBy("id", "other").agg(F.sum("links").alias("n"))
        seen = {(r["id"], r["other"]): r["n"] for r in found.collect()}
        missed, lost = set(), dict.fromkeys(links, 0)
        for (r, shard), n in per_shard.items():
            if n > seen.get((r, shard), 0):
                missed.add(shards[shard][1])
                lost[r] += n - seen.get((r, shard), 0)
        mean = lambda ids: 1 - sum(lost[r] / links[r] for r in ids) / max(1, len(ids))
        shares = (1 - sum(lost.values()) / sum(links.values()), mean(list(links)), mean(few))
        if min(shares) >= recall:
            break
        if exact:
            raise RuntimeError(f"recall of the audit is {min(shares):.4f}, also where all rows are compared")
        if beam < WIDEST:
            beam = min(2 * beam, WIDEST)
        else:
            exact = frozenset(missed)
    return beam, exact


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS,
    beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    1. Equal vectors form a class; one of them, the one with the smallest id, goes on with their number,
       so a third of all rows being one vector adds one row. Their links among themselves are counted.
    2. Classes are dealt to shards by a hash; a task builds the graph of one shard, of at most shard_rows
       vectors, and writes it to the shared folder. Every vector is indexed.
    3. An audit settles the beam; a query whose beam fills with links is asked again with a wider one. Shards
       whose graph misses links at the widest beam are compared row by row.
    4. Blocks of vectors ask every shard. What is found is verified in double precision. A block returns
       counts and a spanning forest of its links per shard, not the pairs.
    5. Forests are joined to components.

    A link that is found counts at both ends. Vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null id,
    link with nothing; vectors of different lengths don't link. Repeated rows are one vector; an id with
    several vectors is one vertex, and its rows show the sum of their links. Ties: only minima of ids
    decide. Labels and other columns are not read. No rows give no rows.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    with scratch(rows.sparkSession) as keep:
        fine = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
        keyed = fine.select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("d1"), F.xxhash64(F.lit(2), "v").alias("d2"))
        ids = stage(keyed.dropDuplicates(["d1", "d2", "vec_id"]), "vectors")
        classes = ids.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
        n = ids.count()
        count = max(shards, -(-n // shard_rows))
        shard = F.pmod(F.xxhash64("rep", "d1"), F.lit(count)).cast("int")
        blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 20_000))
        classes = stage(classes.withColumns({"dim": F.size("v"), "shard": shard}).repartition(blocks, "rep"), "vector_classes")
        folder = work_folder(rows.sparkSession, "graphs")
        graphs = _build(classes, folder)
        beam, exact = _audited(classes, graphs, cosine, beam, audit, recall)
        asked = classes.repartition(blocks, "rep").withColumn("least", F.lit(cosine))
        found = stage(_search(asked, graphs, beam, exact=exact), "vector_links")
        removed(rows.sparkSession, folder)
        members = ids.join(classes.select("d1", "d2", "rep", "copies"), ["d1", "d2"]).select("vec_id", "rep", "copies")
        members = stage(members, "members")
        links = found.where("id <> other").select("id", "other").union(members.where("vec_id <> rep").select("vec_id", "rep"))
        parts = components(links, "id", "other")
        sums = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
        per_class = members.join(sums, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        per_id = per_class.groupBy("vec_id").agg(F.sum("links").alias("links"))
        out = rows.select("vec_id").join(per_id, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        component = F.coalesce("component", "vec_id")
        result = out.select(
            F.col("vec_id").cast(kind).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
        return keep(result, "near_vectors")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
