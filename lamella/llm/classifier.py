"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over standardized statistics. Each partition of the training rows sums its
normal equations, apart for each of FOLDS folds; the driver adds them up and solves for all rows, and for all rows but a
fold. The latter score the rows of that fold, whose (score, label) counts in BINS bins are made monotone by pooling
adjacent violators. That curve calibrates the final scores.

Training reads at most `most` label rows (MOST), so what comes to the driver has a fixed size. All documents are scored.

Results: empty and null texts are scored like any other, from statistics that are 0; very long ones from all of their
text. Without usable labels every score is 0.5; with labels of one kind it is their mean. Label rows that repeat count
once, and of documents that share a labelled doc_id one is learned, that with the least statistics. Equal texts have equal
scores; scores may tie. Rows that repeat are scored each by itself. All columns are kept, and a caller who has a column
named score gives the new one another name. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.stats import RATIOS, labelled, statistics

MOST = 50_000
FEATURES, FOLDS, BINS, SEED = 256, 4, 2048, 71
RIDGE = 1e-3
#: The kernel's width, as a multiple of the square root of the number of statistics.
WIDTH = 0.7


def matrix(stats: dict) -> np.ndarray:
    return np.column_stack([np.asarray(stats[k], np.float64) for k in RATIOS])


@dataclass(frozen=True)
class Fourier:
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d = len(self.mean)
        r = np.random.default_rng(SEED)
        w, b = r.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d)), r.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)
        return np.column_stack([np.ones(len(z)), z])


def pool(scores: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: knots of a curve that never falls. scores ascend."""
    blocks: list[list[float]] = []  # positives, rows, sum of scores
    for s, p, n in zip(scores, positive, count, strict=True):
        blocks.append([p, n, s * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.asarray([b[2] / b[1] for b in blocks]), np.asarray([b[0] / b[1] for b in blocks])


@dataclass(frozen=True)
class Model:
    """Scores from 0 to 1. Pickled to the workers; a few kilobytes."""

    fourier: Fourier | None
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        raw = self.fourier(x) @ self.weights
        # a thousandth of the raw score keeps the order within a flat stretch of the curve
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def _collect_sums(rows: DataFrame, name: str, part) -> np.ndarray:
    """Adds up one float array for each partition. part: (x, y, fold) of a batch to an array."""

    def run(batches):
        total = None
        for b in common.lean(batches):
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, len(RATIOS))
            s = part(x, b.column(1).to_numpy().astype(np.float64), b.column(2).to_numpy())
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_pydict({name: pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(run, f"{name} binary").collect()
    return sum(np.frombuffer(r[0]) for r in got)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Learns from the label rows given, or a sample of `most` of them."""

    def features(batches):
        for b in common.lean(batches):
            x = matrix(statistics(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    sample = labelled(docs, labels, most).select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, y int, x array<double>")
    each = sample.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = common.written(each, "training").coalesce(8)
    d = len(RATIOS)
    moments = _collect_sums(rows, "moments", lambda x, y, f: np.r_[len(x), y.sum(), x.sum(0), (x * x).sum(0)])
    if np.isscalar(moments) or moments[1] in (0, moments[0]):
        return Model(None, None, None, 0.5 if np.isscalar(moments) else moments[1] / moments[0])
    n, mean = moments[0], moments[2 : 2 + d] / moments[0]
    fourier = Fourier(mean, np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0)) + 1e-6)
    k = FEATURES + 1

    def normal(x, y, fold):
        z = fourier(x)
        out = np.zeros((FOLDS, k, k + 1))
        for f in range(FOLDS):
            zf = z[fold == f]
            out[f, :, :k], out[f, :, k] = zf.T @ zf, zf.T @ y[fold == f]
        return out.ravel()

    sums = _collect_sums(rows, "normal", normal).reshape(FOLDS, k, k + 1)
    penalty = RIDGE * n / FEATURES * np.diag(np.r_[0, np.ones(FEATURES)]) + 1e-9 * np.eye(k)

    def solve(s):
        return np.linalg.solve(s[:, :k] + penalty, s[:, k])

    everything = sums.sum(0)
    without = np.stack([solve(everything - s) for s in sums])

    def binned(x, y, fold):
        raw = np.einsum("ij,ij->i", fourier(x), without[fold])
        at = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)].astype(np.float64)

    count, positive, total = _collect_sums(rows, "bins", binned).reshape(3, BINS)
    full = count > 0
    knots = pool(total[full] / count[full], positive[full], count[full])
    return Model(fourier, solve(everything), knots, n and moments[1] / n)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score column, the last one. Narrow: no shuffle."""
    from pyspark.sql import types as T

    at = docs.columns.index("text")

    def run(batches):
        for b in common.lean(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(matrix(statistics(b.column(at)))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
