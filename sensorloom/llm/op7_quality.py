"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import stage, summed, summed_rows, table

#: Cosines that approximate the Gaussian kernel, its width in standard deviations, and the ridge.
COSINES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 11
#: Cells of equal width in which scores are counted for the calibration.
CELLS = 4096
#: Parts of the labelled rows; the curve is fitted to scores of a part by sums of the others.
FOLDS = 5

#: ASCII signs that get a statistic of their own; fixed, listed in code order.
SIGNS = "!#$%&*,.:;?|"


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * N_STATISTICS
    raw = text.encode("utf-8", "replace")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    letters = max(1, upper + lower)
    signs = int(by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum())
    share = by_byte[by_byte > 0] / len(raw)
    short = sum(len(w) <= 3 for w in words)
    ended = sum(x.rstrip()[-1] in ".?!:;" for x in lines)
    loud = sum(x.isupper() for x in lines)
    n_lines = max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        math.log1p(len(words)), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()),
        len(set(words)) / n, len(set(lines)) / n_lines, short / n, upper / letters,
        int(by_byte[48:58].sum()) / chars, signs / chars, signs / n, by_byte[128:].sum() / len(raw),
        -float((share * np.log(share)).sum()), ended / n_lines, loud / n_lines, math.log1p(len(words) / n_lines),
        *(math.sqrt(int(by_byte[ord(s)]) / n) for s in SIGNS),
    ]


N_STATISTICS = 16 + len(SIGNS)


@dataclass(frozen=True)
class Kernel:
    """Standardised statistics to cosines of random projections; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turn = rng.normal(size=(x.shape[1], COSINES)) / (WIDTH * math.sqrt(x.shape[1] / 8))
        start = rng.uniform(0, 2 * math.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([math.sqrt(2 / COSINES) * np.cos(z @ turn + start), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted cells: the knots of a rising line."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([a / w for a, _, w in blocks]), np.array([b / w for _, b, w in blocks])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, N_STATISTICS))


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    #: Of each part of the labelled rows, the weights that the other parts give.
    apart: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        parts = [self.kernel.features(x[i : i + 2_000]) @ self.weights for i in range(0, len(x), 2_000)]
        return np.concatenate(parts) if parts else np.empty(0)

    def raw_apart(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        parts = [
            np.einsum("nf,nf->n", self.kernel.features(x[i : i + 2_000]), self.apart[fold[i : i + 2_000]]) for i in range(0, len(x), 2_000)
        ]
        return np.concatenate(parts) if parts else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.raw(x)
        # A fiftieth of the raw score keeps the order where the curve is flat.
        return 0.98 * np.interp(at, self.knots, self.values) + 0.02 * np.clip((at + 0.5) / 2, 0, 1)


def solved(square: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ridge weights; the last feature is the constant, which is not shrunk."""
    n = max(1.0, square[-1, -1])
    ridge = np.eye(len(square)) * RIDGE * n / COSINES
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(square + ridge, right)


def fitted(known: DataFrame) -> Model | None:
    """The model of labelled rows (x, y, fold); None if there are none. Tasks give sums of fixed size, which
    executors add in two levels; the driver sees one table of each kind and the score cells."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, N_STATISTICS + 1))
        for frame in frames:
            x = _stacked(frame["x"])
            total += [[*x.sum(axis=0), len(x)], [*(x * x).sum(axis=0), len(x)]]
        yield pd.DataFrame({"i": [0, 1], "row": list(total)})

    sums = summed(known.select("x").mapInPandas(moments, "i int, row array<double>"))
    if sums is None or sums[0, -1] == 0:
        return None
    n, (first, second) = sums[0, -1], sums[:, :-1]
    mean = first / n
    kernel = Kernel(mean, np.sqrt(np.maximum(second / n - mean * mean, 0)) + 1e-3)
    width = COSINES + 1

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, width, width + 1))
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                z = kernel.features(_stacked(part["x"]))
                total[fold, :, :-1] += z.T @ z
                total[fold, :, -1] += z.T @ part["y"].to_numpy()
        used = np.flatnonzero(total.any(axis=2))
        if len(used):
            yield pd.DataFrame({"i": used, "row": list(total.reshape(-1, width + 1)[used])})

    tables = np.zeros((FOLDS * width, width + 1))
    rows = known.select("x", "y", "fold").mapInPandas(products, "i int, row array<double>")
    for i, row in summed_rows(rows):
        tables[i] = row
    tables = tables.reshape(FOLDS, width, width + 1)
    whole = tables.sum(axis=0)
    weights = solved(whole[:, :-1], whole[:, -1])
    apart = np.stack([solved((whole - t)[:, :-1], (whole - t)[:, -1]) for t in tables])
    model = Model(kernel, weights, apart, np.zeros(1), np.zeros(1))

    @F.pandas_udf("double")
    def raw(x: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series(model.raw_apart(_stacked(x), fold.to_numpy(np.int64)))

    cell = F.floor(F.greatest(F.least(raw("x", "fold"), F.lit(1.5)), F.lit(-0.5)) * (CELLS / 2))
    counted = known.select("y", cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    cells = counted.toPandas().sort_values("cell")  # CELLS at most
    centre = (cells["cell"].to_numpy(np.float64) + 0.5) / (CELLS / 2)
    knots, values = isotonic(centre, cells["y"].to_numpy(np.float64), cells["n"].to_numpy(np.float64))
    return Model(kernel, weights, apart, knots, values)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    1. Statistics of each whole text, in one pass, are staged; texts are not read again or moved.
    2. Labelled rows that are not held out give means and deviations, then the normal equations of their
       features: every task sums products of fixed size, whatever the number of rows, so no group matters.
    3. Of each of five parts of these rows, the ridge solution of the other parts gives scores; counts of labels
       per cell of such scores, a fixed number of cells, are made monotone, and that curve maps every score of
       the whole solution into 0 to 1.

    Null and empty texts have all statistics 0 and are scored like others; a null id is not held out and
    has no label; repeated ids are scored row by row, and each pair of row and label counts; null
    labels are left out; labels other than 0 and 1 count as 1 if above 0. Without usable labels every score is
    0.5. Only doc_id, text and labels.quality are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [np.array(statistics(t), np.float32) for t in frame["text"]]})

    ids = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    measured = stage(ids.mapInPandas(measure, "id string, x array<float>"), "statistics")
    marks = labels.where("quality is not null").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") > 0).cast("double").alias("y"))
    # Equal texts are in one part.
    fold = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")
    known = stage(measured.where(~held_out(F.col("id"))).join(marks, "id").select("x", "y", fold), "labelled")
    result = measured.select("id", "x")
    model = fitted(known)
    if model is None:
        plain = result.select("id", F.lit(0.5).alias("score"))
    else:

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.scores(_stacked(x)))

        plain = result.select("id", score("x").alias("score"))
    return plain.select(
        F.col("id").cast(kind).alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
