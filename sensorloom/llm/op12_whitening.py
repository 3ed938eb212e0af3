"""Whitening of embeddings: a distributed covariance, float32 eigenvectors corrected in higher precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import scratch, stage, summed, table

#: Steps of the grid that entries are floored to, and components to give.
STEPS, COMPONENTS = 256, 4
#: Correction rounds; four are usual, as the error squares in each.
ROUNDS = 24
LONG = 2**63


def usable(v: Column) -> Column:
    """Vectors with entries, all of them finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _size(x: np.ndarray) -> int:
    """The largest absolute entry; that of the least long has no long."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in longs where they hold it, in Python's integers else."""
    if n * _size(x) + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; None beyond a long."""
    if d.dtype != object and _size(d) ** 2 * d.shape[1] < LONG:
        return np.einsum("nd,nd->n", d, d).tolist()
    wide = (d.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < LONG else None for v in wide]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Positions of eigenvalues that lie within `width` of the next one, by group of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Vectors come from a float32 solver. A round of Ogita and Aishima measures with double-precision
    products how far they are from orthogonal (r) and from diagonalising (s), and corrects all pairs whose
    eigenvalues are farther apart than the error of that measure; the error squares. Pairs that are closer
    form clusters: the correction only makes them orthogonal to the rest and each other, and a small
    eigenproblem of the matrix shifted to the cluster turns them within their space.
    """
    d, scale = len(a), np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(d), np.eye(d)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    norm, eps = np.linalg.norm(a, 2), np.finfo(np.float64).eps
    best, kept, values = np.inf, x, np.diag(a)
    for _ in range(ROUNDS):
        r = np.eye(d) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # what rounding makes of it is no turn
        lam = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(lam)
        error = np.linalg.norm(off) + norm * np.linalg.norm(r)
        # Rounding of s over a gap, squared, is to stay rounding.
        width = max(2 * error, np.sqrt(eps) * norm)
        if error < best:
            kept, values = x, lam
        if error < 4 * eps * norm or error > 0.5 * best and error < 64 * d * eps * norm:
            break
        best = min(best, error)
        gap = lam[None, :] - lam[:, None]
        far = np.abs(gap) > width
        e = np.where(far, (s + lam[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        for group in clusters(lam, width):
            part = x[:, group]
            middle = lam[group].mean()
            block = part.T @ (a @ part - middle * part)
            x[:, group] = part @ np.linalg.eigh((block + block.T) / 2)[1]
    x = kept / np.linalg.norm(kept, axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Vectors of the fit list and their exact sums by dimension; the driver sees one number for each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch)
            small = _size(x) * max(1, len(x)) < LONG
            total = total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": [n] * len(total), "total": list(map(str, total))})

    parts = fit.select("x").mapInArrow(add, "i int, n long, total string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return (found[0]["n"], [int(r["total"]) for r in sorted(found)]) if found else (0, [])


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list, divisor n; entries are centred, then multiplied. A task keeps one matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = centred(_matrix(batch), n, sums)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))}
            )

    return summed(fit.select("x").mapInArrow(multiply, "i int, row array<double>")) / n


def _identity_error(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = turn.shape[1]
    if k == 0:
        return 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = centred(_matrix(batch), n, sums) @ turn
            yield pa.RecordBatch.from_pydict({f"w{c}": w[:, c] for c in range(k)})

    white = fit.select("x").mapInArrow(project, ", ".join(f"w{c} double" for c in range(k)))
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    row = white.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): `components` rows for every
    usable row of (vec_id, embedding).

    1. Entries are floored to steps of 1/256, in the JVM. Equal vectors count once: they are reduced before
       and after one shuffle, so a vector that a third of all rows hold is a row per task.
    2. Exact sums by dimension, then the covariance of the centred vectors: one matrix a task, added by
       executors in two levels. The driver sees d sums and one d x d matrix, whatever the number of rows.
    3. `eigen` solves it; all rows are projected on the first components with one broadcast of 4 x d numbers.

    Vectors that are null or empty or hold null or non-finite entries are left out; so are those of another
    length than most have (ties: the longer one stays). Entries beyond a long take its nearest value. A
    deviation that no long holds is null. A component without variance (a single vector, equal entries,
    fewer vectors than dimensions) has explained 0 and whitened null and is no part of identity_error.
    Fewer dimensions than components give as many rows as there are dimensions. Rows with null or repeated
    ids are rows like others. No usable rows give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    longs = F.transform("v", lambda c: F.floor(c.cast("double") * STEPS))
    fine = rows.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v"))).select("vec_id", longs.alias("x"))
    lengths = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    fine = fine.where(F.size("x") == lengths["d"])
    with scratch(spark) as keep:
        fit = stage(fine.select("x").distinct(), "fit_list")
        n, sums = _sums(fit)
        values, vectors = eigen(_covariance(fit, n, sums))
        trace = float(values.sum())
        k = min(components, len(sums))
        # Below this an eigenvalue is rounding of a matrix of this size.
        real = int((values[:k] > len(sums) * np.finfo(np.float64).eps * max(trace, 0.0)).sum()) if trace > 0 else 0
        turn = vectors[:, :real] / np.sqrt(values[:real])
        explained = [float(v) / trace for v in values[:real]] + [0.0] * (k - real)
        error = float(_identity_error(fit, n, sums, turn))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch)
                m = len(x)
                d = deviations(x, n, sums)
                w = np.full((m, k), np.nan)
                w[:, :real] = (d.astype(np.float64) / n) @ turn
                each = np.repeat(np.arange(m), k)
                which = np.tile(np.arange(k), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)), pa.array(which + 1, pa.int32()), pa.array(np.full(m * k, n)),
                        pa.array(square_sums(d), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), mask=which >= real),
                        pa.array(np.array(explained)[which]), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return keep(fine.mapInArrow(project, schema), "whitened")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
