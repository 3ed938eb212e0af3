"""Eigenvectors against a double-precision solver, whitening against a direct one."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest

from sensorloom.llm import op12_whitening as op12

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component int, d double"
FOLDER = Path("/root/testdata/sf0.001")


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 40),
        [5.0] * 20 + [1.0] * 20,  # equal ones
        [1 + 1e-9 * i for i in range(30)],  # closer than float32 tells apart
        [1, 1 + 1e-12, 1e-7, 1e-7 + 1e-13, 3, 0, 0, 0],
        10.0 ** np.arange(0, -14, -1.0),
        [0.0] * 5,
        [7.0],
        1e300 * np.arange(1, 6),
    ],
)
def test_eigen(values):
    a = symmetric(np.array(values, float))
    a = (a + a.T) / 2
    e, x = op12.eigen(a)
    want = np.linalg.eigvalsh(a)[::-1]
    top = max(np.abs(want).max(), 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * top
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
    assert np.abs(a / top @ x - x * (e / top)).max() < 1e-13
    assert (np.diff(e) <= 0).all()


def test_float32_alone_would_not_do():
    a = symmetric(np.linspace(1, 2, 40))
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)[:, ::-1]
    good, found = np.linalg.eigh(a)[1][:, ::-1], op12.eigen(a)[1]
    away = lambda x: np.abs(np.abs((x * good).sum(axis=0)) - 1).max() + np.abs(np.abs(x.T @ good) - np.eye(40)).max()
    assert away(rough) > 1e-7 and away(found) < 1e-12


def plain(rows, k=4):
    """(vec_id, component) -> the other columns, the whitened one without a sign."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in fine]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    fine = [(i, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, v in fine if len(v) == d]
    fit = [list(v) for v in {tuple(v) for _, v in fine}]
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(d)]
    z = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in fine:
        w = (np.array(v) - np.array(sums) / n) @ u / np.sqrt(e)
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        out += [(i, c + 1, n, dev, abs(w[c]), e[c] / e.sum()) for c in range(min(k, d))]
    return out


def hold(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in found], [r[4] for r in want], rtol=1e-8, atol=1e-8)
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-10)


def vectors(n=300, d=12, seed=4):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + rng.normal(size=d) * 20).astype(np.float32).tolist()


def test_against_a_direct_solution(spark):
    x = vectors()
    rows = list(enumerate(x))
    rows += [(1_000 + i, x[3]) for i in range(150)]  # a third of all rows is one vector
    rows += [(3, x[3]), (3, x[3]), (4, x[9]), (None, x[5]), (None, x[5])]
    nan, inf = float("nan"), float("inf")
    odd = [(9_000, None), (9_001, []), (9_002, [nan] * 12), (9_003, [None] * 12), (9_004, [inf] + [0.0] * 11), (9_005, [1.0, 2.0])]
    zero = [(8_000, [0.0] * 12), (8_001, [-0.0] * 12)]
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in [*rows, *odd, *zero]], SCHEMA)
    found = op12.whitened(frame.repartition(5)).collect()
    hold(found, plain([*rows, *odd, *zero]))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_given_table(spark):
    if not FOLDER.exists():
        pytest.skip("the given tables are not here")
    frame = spark.read.parquet(str(FOLDER / "embeddings.parquet"))
    found = op12.op12_whitening(spark, str(FOLDER)).collect()
    hold(found, plain([(r.vec_id, r.embedding) for r in frame.collect()]))
    assert found[0].identity_error < 1e-9


def test_no_variance(spark):
    def of(rows):
        return op12.whitened(spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)).collect()

    assert of([]) == [] and of([(1, None), (2, [])]) == []
    one = of([(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, None, 0.0, 0.0) for c in (1, 2) for _ in "ab"
    ] or len(one) == 4
    assert all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, 0.0, 0.0) for r in one)
    line = of([(i, [float(i), 5.0, 5.0, 5.0, 5.0]) for i in range(9)])  # one direction
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True), (4, True)}
    assert abs(line[0].identity_error) < 1e-12 and {r.explained for r in line if r.component == 1} == {1.0}


def test_huge_entries(spark):
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(i, [v, float(i), -v]) for i, v in enumerate((1e300, -1e300, 1e18, 3.0, 0.0))]
    found = op12.whitened(spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema)).collect()
    assert len(found) == 15 and all(r.deviation is None for r in found) and all(math.isfinite(r.whitened or 0) for r in found)
    rows = [(i, [float(i) * 2**20, 1.0]) for i in range(4)]
    found = op12.whitened(spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema)).collect()
    assert {r.vec_id: r.deviation for r in found} == {i: (4 * i * 2**28 - 6 * 2**28) ** 2 for i in range(4)}
