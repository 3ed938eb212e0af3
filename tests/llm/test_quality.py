"""Quality scores on rows held out."""

from __future__ import annotations

import random
import zlib

import numpy as np

from sensorloom.llm import op7_quality as op7
from sensorloom.llm.op7_quality import Kernel, isotonic, quality

from .brute import AWKWARD, prose, table


def rows(n=900):
    r = random.Random(6)
    out, marks = [], []
    for i in range(n):
        words = prose(i, r.randint(5, 200), 3_000)
        good = int(r.random() < 0.8)
        if not good:
            words = [w + r.choice(("!!", "###", " |")) for w in words]
        out.append((i, " ".join(words)))
        marks.append((i, good))
    return out, marks


def test_held_out_rows_are_told_apart(spark):
    docs, marks = rows()
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, quality int")
    found = quality(table(spark, docs), labels).collect()
    assert len(found) == len(docs)
    truth = dict(marks)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [(r.score, truth[r.doc_id]) for r in found if r.held_out]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == bool(y) for s, y in test]) > 0.95


def test_against_a_direct_solution(spark):
    """Weights of all rows, and of each part's rest, are those of plain ridge regressions; the curve is that of
    the scores of rows that took no part."""
    docs, marks = rows(400)
    x = np.array([op7.statistics(t) for _, t in docs], np.float32).astype(float)
    y = np.array([m for _, m in marks], float)
    fold = np.arange(len(docs)) % op7.FOLDS
    frame = spark.createDataFrame([([float(v) for v in a], float(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)], "x array<float>, y double, fold int")
    model = op7.fitted(frame.repartition(7))
    kernel = Kernel(x.mean(axis=0), x.std(axis=0) + 1e-3)
    z = kernel.features(x)

    def ridge(z, y):
        penalty = np.diag([op7.RIDGE * len(z) / op7.COSINES] * op7.COSINES + [1e-9])
        return np.linalg.solve(z.T @ z + penalty, z.T @ y)

    assert np.allclose(z @ model.weights, z @ ridge(z, y), atol=1e-5)
    apart = np.empty(len(y))
    for f in range(op7.FOLDS):
        apart[fold == f] = z[fold == f] @ ridge(z[fold != f], y[fold != f])
    assert np.allclose(model.raw_apart(x, fold), apart, atol=1e-5)
    cell = np.floor(np.clip(model.raw_apart(x, fold), -0.5, 1.5) * op7.CELLS / 2)
    at = np.unique(cell)
    knots, values = isotonic((at + 0.5) / (op7.CELLS / 2), np.array([y[cell == c].mean() for c in at]), np.array([(cell == c).sum() for c in at], float))
    assert np.allclose(model.knots, knots) and np.allclose(model.values, values)


def test_one_labelled_row(spark):
    docs, marks = rows(30)
    one = spark.createDataFrame([m for m in marks if zlib.crc32(str(m[0]).encode()) % 3 != 1][:1], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality(table(spark, docs), one).collect())


def test_held_out_labels_do_not_matter(spark):
    docs, marks = rows(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in marks]
    a, b = (sorted((r.doc_id, r.score) for r in quality(table(spark, docs), spark.createDataFrame(m, "doc_id long, quality int")).collect()) for m in (marks, flipped))
    assert np.allclose(a, b, atol=1e-9)


def test_awkward_rows(spark):
    docs, marks = rows(200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = quality(table(spark, [*docs, *AWKWARD]), labels).collect()
    assert len(found) == 200 + len(AWKWARD) and all(r.score is not None for r in found)
    assert {r.score for r in quality(table(spark, AWKWARD), labels.limit(0)).collect()} == {0.5}
    assert quality(table(spark, []), labels).collect() == []


def test_curve_rises():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0, 0.5, 0.4, 1.0]), np.ones(6))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 28))
    f = Kernel(np.zeros(28), np.ones(28)).features(x)[:, :-1]
    width = 4.0 * np.sqrt(28 / 8)
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2))
    assert np.abs(f @ f.T - true).mean() < 0.06
