"""Links of vectors against all pairs."""

from __future__ import annotations

import numpy as np

from sensorloom.llm import op6_embeddings as op6
from sensorloom.llm.common import opened, written
from sensorloom.llm.hnsw import Graph, units
from sensorloom.llm.op6_embeddings import near_vectors

from .brute import roots

SCHEMA = "vec_id long, embedding array<float>, label int, id long, links long, rep long, v string"


def vectors(n=1_500, hot=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 32))
    for i in range(0, n // 3, 2):
        x[i + 1] = x[i] + rng.normal(size=32) * rng.uniform(0, 0.15)
    x[-hot:] = x[-hot] + rng.normal(size=(hot, 32)) * 0.05
    return x.astype(np.float32)


def test_graph_finds_what_all_pairs_find():
    x = units(vectors())
    graph, more = Graph.load(Graph.build(x).dump(extra=np.arange(3)))
    assert list(more["extra"]) == [0, 1, 2]
    i, j = graph.within(x, 0.9, 32)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    a, b = np.nonzero(x @ x.T >= 0.9)
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= want and len(found) >= 0.98 * len(want)


def test_links_and_components(spark):
    x = vectors(900, 200)
    rows = [(i, [float(v) for v in x[i]], i % 5) for i in range(len(x))]
    rows += [(5_000 + i, rows[3][1], 0) for i in range(40)]  # copies
    nan = float("nan")
    odd = [(9_000, None), (9_001, []), (9_002, [0.0] * 32), (9_003, [nan] * 32), (9_004, [None] * 32), (9_005, [1.0, 2.0]), (None, rows[3][1])]
    frame = spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in [*rows, *odd]], SCHEMA)
    got = near_vectors(frame, shards=3).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.vec_id: r for r in got}
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    want = roots(ids, [(ids[p], ids[q]) for p, q in zip(a, b, strict=True) if p < q])
    counts = near.sum(axis=1)
    assert sum(found[i].n_links for i in ids) >= 0.98 * counts.sum()
    assert all(found[i].n_links <= c for i, c in zip(ids, counts, strict=True))
    assert sum(found[i].n_links for i in ids) % 2 == 0  # both ends count a link
    assert {i: found[i].component_id for i in ids} == want
    assert all(found[i].kept == (want[i] == i) for i in ids)
    for i, *_ in odd[:-1]:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, True)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0], *[None] * 5), (1, [1.0, 0.0], *[None] * 5)], SCHEMA)
    assert [(r.n_links, r.component_id) for r in near_vectors(one).collect()] == [(0, 1)] * 2


def without_ways(monkeypatch, lost):
    """Graphs of this test have no link to the vertices of the ids in `lost`, so no beam reaches them."""
    build = op6._build

    def poor(classes, folder):
        shards = build(classes, folder)
        for _, path in shards:
            with opened(path) as file:
                graph, data = Graph.load(file.read())
            shut = np.isin(data["ids"][graph.order], lost)
            for links in graph.layers:
                links[(links >= 0) & shut[links]] = -1
            with written(path) as out:
                out.write(graph.dump(**data))
        return shards

    monkeypatch.setattr(op6, "_build", poor)


def test_graphs_in_pieces_lose_no_links(spark, monkeypatch):
    """The widest beam is audited too, and what it misses is found without the graph."""
    without_ways(monkeypatch, list(range(400)))
    x = vectors(400, 50)
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], *[None] * 5) for i in range(len(x))], SCHEMA)
    found = {r.vec_id: r.n_links for r in near_vectors(frame, shards=2, beam=1_536).collect()}
    m = units(x.astype(np.float64)).astype(np.float64)
    assert found == dict(enumerate(((m @ m.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_a_large_group_does_not_hide_missed_pairs(spark, monkeypatch):
    """Of 40,000 links only those of pairs can't be found by the graph; they are some 70 of them."""
    without_ways(monkeypatch, list(range(200)))
    x = vectors(420, 200)
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], *[None] * 5) for i in range(len(x))], SCHEMA)
    found = {r.vec_id: r.n_links for r in near_vectors(frame, shards=2).collect()}
    m = units(x.astype(np.float64)).astype(np.float64)
    counts = (m @ m.T >= 0.9).sum(axis=1) - 1
    assert 50 < counts[:200].sum() < 0.01 * counts.sum()
    assert {i: found[i] for i in range(200)} == dict(enumerate(counts[:200].tolist()))


def test_links_outside_the_first_pools(spark, monkeypatch):
    """Few vectors have links, none of them in the first pool: further pools are drawn until some are met."""
    monkeypatch.setattr(op6, "POOL", 40)
    monkeypatch.setattr(op6, "ROUNDS", 100)
    without_ways(monkeypatch, list(range(60)))
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 32))
    x[1:60:2] = x[0:60:2] + rng.normal(size=(30, 32)) * 0.05
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], *[None] * 5) for i in range(900)], SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, shards=2, audit=20).collect()}
    assert found == {i: (int(i < 60), i - i % 2 if i < 60 else i) for i in range(900)}


def test_nearest_neighbours_are_audited_where_links_are_rare(spark, monkeypatch):
    """No pool that is drawn has a link; the graphs are then held against nearest neighbours."""
    monkeypatch.setattr(op6, "POOL", 30)
    monkeypatch.setattr(op6, "ROUNDS", 1)
    without_ways(monkeypatch, list(range(0, 900, 2)))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x[888] = x[886] + 0.01
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], *[None] * 5) for i in range(900)], SCHEMA)
    classes = frame.selectExpr("vec_id rep", "embedding v", "32 dim", "1L copies", "0 shard")
    drawn = op6._drawn(classes.where("rep not in (886, 888)"), 0.9, 20).collect()
    assert len(drawn) == 20 and all(0 < r.least < 0.9 for r in drawn)
    found = {r.vec_id: r.n_links for r in near_vectors(frame, shards=2, audit=20).collect()}
    assert found == {i: int(i in (886, 888)) for i in range(900)}


def test_huge_entries_are_drawn_whole(spark):
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(i, [1e300 * (1 + i), 1e300, 0.0]) for i in range(4)] + [(9, [1e-300, 0.0, 0.0])]
    found = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema)).collect()}
    u = np.array([[1 + i, 1, 0] for i in range(4)] + [[1, 0, 0]], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert list(found.values()) == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist() or found == dict(zip((0, 1, 2, 3, 9), ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist(), strict=True))
