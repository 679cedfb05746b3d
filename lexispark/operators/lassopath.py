"""L1 logistic regression along a path of penalties, all folds together.

Each pass over the rows yields, for every open fold, the loss, the gradient of all features and the curvature (weighted Gram matrix) of a working
set. The driver then solves each fold's quadratic model by coordinate descent, starting from the coefficients of the penalty before. The working
set holds the features that are in use or pass the strong rule, and those that turn out to break the optimality conditions, which are checked
for all features at every pass; so screening never changes the solution. Features are scaled by their deviation in the fold's training rows,
as ``LogisticRegression`` scales them, and the objective is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16  # numbers of a partial sum in one row
CELLS = 1 << 22  # cells of a dense block of rows x working set in a task
MAX_WORKING = 1024  # features whose curvature is summed in one pass
TINY = 1e-300  # a feature whose curvature is wanted though its condition holds


def sparse_cells(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of the rows, feature numbers, values) of a vector column, of sparse and dense rows."""
    cells = batch.column(column)
    kind = cells.field("type").to_numpy(zero_copy_only=False)
    indices, values = cells.field("indices"), cells.field("values")
    vo = values.offsets.to_numpy()
    flat = values.values.to_numpy()
    sizes = np.diff(vo)
    bounds = vo - vo[0]
    places = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], sizes)  # dense rows: the place is the feature
    sparse = np.repeat(kind == 0, sizes)
    if sparse.any():
        io = indices.offsets.to_numpy()
        places[sparse] = indices.values.to_numpy()[io[0] : io[-1]]
    return bounds, places, flat[vo[0] : vo[-1]]


@dataclass
class Fit:
    """The state of one fold, in scaled features."""

    fold: int
    scale: np.ndarray  # deviation of each feature, 0 for constant ones
    n: float
    intercept: float
    beta: np.ndarray
    path: list = field(default_factory=list)  # (intercept, beta in raw features) of each finished penalty
    at: int = 0  # number of the penalty it is at
    accepted: tuple | None = None  # objective, intercept and beta of the last point from which a step was taken
    halvings: int = 0

    def raw(self) -> np.ndarray:
        return np.divide(self.beta, self.scale, out=np.zeros_like(self.beta), where=self.scale > 0)


def _sums(rows: DataFrame, fits: Sequence[Fit], working: np.ndarray, n_features: int) -> dict[int, np.ndarray]:
    """Per fold: loss, sum of weights, residual sum, gradient of all features, weighted sums and Gram matrix of the working set.

    Raw features, sums over the fold's training rows. A task holds one partial sum per fold; Spark adds the pieces up before and after the shuffle.
    """
    folds = np.array([f.fold for f in fits])
    starts = np.array([f.intercept for f in fits])
    raw = np.stack([f.raw() for f in fits])
    used = np.flatnonzero((raw != 0).any(axis=0))
    weights, m = raw[:, used].T.copy(), len(working)
    length = 3 + n_features + m + m * m

    def block(places, values, rows_of, n, columns):
        at = np.full(n_features, -1, dtype=np.int64)
        at[columns] = np.arange(len(columns))
        to = at[places]
        hit = to >= 0
        return np.bincount(rows_of[hit] * len(columns) + to[hit], weights=values[hit], minlength=n * len(columns)).reshape(n, len(columns))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), length))
        step = max(1, CELLS // max(1, m, len(used)))
        seen = False
        for batch in batches:
            bounds, places, values = sparse_cells(batch, "features")
            label = batch.column("label").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for a in range(0, len(label), step):
                b = min(a + step, len(label))
                lo, hi = bounds[a], bounds[b]
                p, v = places[lo:hi], values[lo:hi]
                rows_of = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                margins = block(p, v, rows_of, b - a, used) @ weights + starts
                x = block(p, v, rows_of, b - a, working)
                y = label[a:b]
                seen = seen or b > a
                for i in range(len(folds)):
                    part = (fold[a:b] != folds[i]).astype(np.float64)
                    z = margins[:, i]
                    prob = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    rest, w = (y - prob) * part, prob * (1 - prob) * part
                    t = total[i]
                    t[0] += ((np.logaddexp(0, z) - y * z) * part).sum()
                    t[1] += w.sum()
                    t[2] += rest.sum()
                    t[3 : 3 + n_features] += np.bincount(p, weights=v * rest[rows_of], minlength=n_features)
                    if m:
                        wx = x * w[:, None]
                        t[3 + n_features : 3 + n_features + m] += wx.sum(axis=0)
                        t[3 + n_features + m :] += (x.T @ wx).ravel()
        if seen:
            for i in range(len(folds)):
                cuts = [total[i][k : k + PIECE] for k in range(0, length, PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.list_(pa.float64()))],
                    names=["fit", "piece", "cells"],
                )

    parts = rows.select("fold", F.col("label").cast("double").alias("label"), "features").mapInArrow(partial, "fit INT, piece INT, cells ARRAY<DOUBLE>")
    summed = parts.groupBy("fit", "piece").agg(vector_to_array(Summarizer.sum(array_to_vector("cells"))).alias("cells")).collect()
    out = np.zeros((len(folds), length))
    for r in summed:
        out[r["fit"], r["piece"] * PIECE : r["piece"] * PIECE + len(r["cells"])] = r["cells"]
    return dict(zip(folds.tolist(), out))


def soft(x: float, by: float) -> float:
    return x - by if x > by else x + by if x < -by else 0.0


def quadratic_step(beta: np.ndarray, gradient: np.ndarray, gram: np.ndarray, penalty: float, tol: float = 1e-10, sweeps: int = 1000) -> np.ndarray:
    """argmin over b of  -gradient'(b - beta) + (b - beta)' gram (b - beta) / 2 + penalty |b|  by coordinate descent."""
    b, slope = beta.copy(), gradient.copy()  # slope: gradient of the model at b
    diagonal = np.diag(gram)
    usable = np.flatnonzero(diagonal > 1e-12)
    todo = usable
    for _ in range(sweeps):
        largest = 0.0
        for j in todo:
            new = soft(b[j] * diagonal[j] + slope[j], penalty) / diagonal[j]
            change = new - b[j]
            if change:
                slope -= gram[j] * change
                b[j] = new
                largest = max(largest, change * change * diagonal[j])
        if largest <= tol:
            if len(todo) == len(usable):
                break
            todo = usable  # all features once more
        else:
            todo = np.flatnonzero((b != 0) & (diagonal > 1e-12))
    return b


def _violation(beta: np.ndarray, gradient: np.ndarray, penalty: float) -> np.ndarray:
    """How far each feature is from its optimality condition."""
    return np.where(beta != 0, np.abs(gradient - penalty * np.sign(beta)), np.maximum(np.abs(gradient) - penalty, 0))


def fold_scales(rows: DataFrame, folds: int) -> tuple[list[Fit], np.ndarray]:
    """A fit for the training rows of each fold and one for all rows (fold -1), at zero coefficients; and the largest penalty of all rows."""
    stats = rows.groupBy("fold", "label").agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
    ).select("fold", "label", "s.*").collect()
    parts = [(r["fold"], r["label"], r["count"], r["mean"].toArray(), r["variance"].toArray()) for r in stats]
    fits = []
    for fold in [-1, *range(folds)]:
        mine = [p for p in parts if p[0] != fold]
        n = sum(p[2] for p in mine)
        ones = sum(p[2] for p in mine if p[1] == 1)
        if not 0 < ones < n:
            raise ValueError("the training data has one class only")
        mean = sum(p[2] * p[3] for p in mine) / n
        squares = sum(max(p[2] - 1, 0) * p[4] + p[2] * (p[3] - mean) ** 2 for p in mine)
        scale = np.sqrt(squares / max(n - 1, 1))
        scale[scale < 1e-12] = 0
        fits.append(Fit(fold, scale, n, float(np.log(ones / (n - ones))), np.zeros(len(mean))))
    ones = [p for p in parts if p[1] == 1]
    mean = sum(p[2] * p[3] for p in parts) / fits[0].n
    cov = np.abs(sum(p[2] * (p[3] - mean) for p in ones)) / fits[0].n
    return fits, np.divide(cov, fits[0].scale, out=np.zeros_like(cov), where=fits[0].scale > 0)


def fit_path(rows: DataFrame, penalties: Sequence[float], folds: int, tol: float = 1e-3, max_passes: int = 1000, max_working: int = MAX_WORKING,
             fits: list[Fit] | None = None) -> dict[int, list[tuple[float, np.ndarray]]]:
    """Coefficients ``(intercept, beta)`` at each of the falling ``penalties``, without each fold and (fold -1) for all rows.

    ``rows``: ``features``, ``label`` and ``fold`` (0 ..), stored, as every pass reads it. A fold is done with a penalty when no feature is further
    from its optimality condition than ``tol`` times the penalty; it then goes on to the next one, whatever the other folds do. A pass takes
    the curvature of at most ``max_working`` features, those furthest from their condition; where more are needed, the next passes take the
    others, with the same solution. A step that raises a fold's objective is halved. The driver holds some rows of
    features per fold and the Gram matrices.
    """
    fits = fits or fold_scales(rows, folds)[0]
    p = len(fits[0].beta)
    open_, working = list(fits), np.array([], dtype=np.int64)
    for _ in range(max_passes):
        sums, m = _sums(rows, open_, working, p), len(working)
        wanted = np.zeros(p)
        for f in open_:
            s = sums[f.fold]
            inverse = np.divide(1.0, f.scale, out=np.zeros(p), where=f.scale > 0)
            loss, gradient, size = s[0] / f.n, s[3 : 3 + p] * inverse / f.n, np.abs(f.beta).sum()
            if f.accepted and loss + penalties[f.at] * size > f.accepted[0] * (1 + 1e-12) and f.halvings < 30:
                f.halvings += 1
                f.intercept, f.beta = (f.intercept + f.accepted[1]) / 2, (f.beta + f.accepted[2]) / 2
                wanted = np.maximum(wanted, (f.beta != 0) * TINY)
                continue
            f.halvings = 0
            while f.at < len(penalties):
                penalty = penalties[f.at]
                off = _violation(f.beta, gradient, penalty)
                if max(off.max(initial=0), abs(s[2]) / f.n) > tol * penalty:
                    break
                f.path.append((f.intercept, f.raw()))
                f.at += 1
            if f.at == len(penalties):
                continue
            f.accepted = (loss + penalty * size, f.intercept, f.beta)
            scale = inverse[working]
            gram = s[3 + p + m :].reshape(m, m) * np.outer(scale, scale) / f.n
            cross, mass = s[3 + p : 3 + p + m] * scale / f.n, max(s[1] / f.n, 1e-12)
            # the intercept is solved for exactly, what is left are centred features
            at = f.beta[working]
            new = quadratic_step(at, gradient[working] - cross * s[2] / f.n / mass, gram - np.outer(cross, cross) / mass, penalty)
            f.intercept += (s[2] / f.n - cross @ (new - at)) / mass
            f.beta = f.beta.copy()
            f.beta[working] = new
            following = penalties[min(f.at + 1, len(penalties) - 1)]
            strong = (np.abs(gradient) >= 2 * following - penalty) & (f.scale > 0)
            wanted = np.maximum(wanted, np.where((f.beta != 0) | (off > 0) | strong, off + TINY, 0))
        open_ = [f for f in open_ if f.at < len(penalties)]
        if not open_:
            return {f.fold: f.path for f in fits}
        working = np.flatnonzero(wanted)
        if len(working) > max_working:
            working = np.sort(working[np.argsort(-wanted[working], kind="stable")[:max_working]])
    raise RuntimeError(f"the penalties were not done in {max_passes} passes")


def held_out_scores(rows: DataFrame, path: dict[int, list[tuple[float, np.ndarray]]]) -> DataFrame:
    """`model, fold, prob, actual` of the held-out rows of each fold, `model` the number of the penalty."""
    n = len(path[0])
    coefficients = {fold: (np.array([i for i, _ in fits]), np.stack([b for _, b in fits]).T.copy()) for fold, fits in path.items() if fold >= 0}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, places, values = sparse_cells(batch, "features")
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                start, weights = coefficients[int(fold[i])]
                z = start + values[a:b] @ weights[places[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([int(fold[i])] * n, pa.int32()), pa.array(z), pa.array([int(label[i])] * n, pa.int32())],
                    names=["model", "fold", "prob", "actual"],
                )

    return rows.select("fold", "label", "features").mapInArrow(score, "model INT, fold INT, prob DOUBLE, actual INT")
