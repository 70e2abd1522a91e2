"""Robust kernel regression: random Fourier features and a Huber loss whose scale is fitted too, by steps of Newton's kind.

A step needs sums of products over the rows, so it is one pass, and what the rows are lifted to never leaves a task. The objective is
convex and smooth almost everywhere; a handful of passes reach its minimum, where a gradient method takes one for each of dozens
of iterations and keeps all lifted rows for them.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP_ROWS = 1 << 12  # rows lifted at once in a task
TOLERANCE = 1e-10  # the descent a further step promises, as a share of the loss, below which the fit ends


@dataclass(frozen=True)
class FourierFeatures:
    """Random features whose inner products approach an RBF kernel (Rahimi and Recht 2007)."""

    directions: np.ndarray
    offsets: np.ndarray

    @classmethod
    def drawn(cls, width: int, gamma: float, n_components: int, seed: int) -> FourierFeatures:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), (width, n_components)), rng.uniform(0.0, 2.0 * np.pi, n_components))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.directions
        z += self.offsets
        np.cos(z, out=z)
        z *= np.sqrt(2.0 / len(self.offsets))
        return z


@dataclass(frozen=True)
class KernelFit:
    features: FourierFeatures
    coefficients: np.ndarray
    intercept: float
    scale: float
    passes: int

    def predict(self, x: Column) -> Column:
        """The prediction for an array of features."""
        features, weights, intercept = self.features, self.coefficients, self.intercept

        @F.arrow_udf("double")
        def run(x: pa.Array) -> pa.Array:
            values = _matrix(x, len(features.directions))
            out = [features.lift(values[i:i + STEP_ROWS]) @ weights + intercept for i in range(0, len(values), STEP_ROWS)]
            return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

        return run(x)


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


Point = tuple[np.ndarray, float, float]


def _sums(df: DataFrame, asked: list[tuple[FourierFeatures, Point | None]]) -> list[dict[str, np.ndarray | float]]:
    """For each of several fits its sums over the rows (x, label) at (weights with the intercept last, scale, shape), in one pass; plain
    sums of products without a point.

    With u the lifted row and a one, and r its residual: ``gram`` is the sum of u u' over the rows whose residual is within shape times
    scale, ``cross`` that of r u, ``square`` that of r r; ``pull`` is the sum of sign(r) u over the others, ``far`` that of abs(r).
    """
    width = len(asked[0][0].directions)
    shapes = [len(features.offsets) + 1 for features, _ in asked]
    cuts = [np.cumsum([size * (size + 1) // 2, size, size, 1, 1, 1]) for size in shapes]
    starts = np.cumsum([0, *(c[-1] + 1 for c in cuts)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros((size, size)), np.zeros(size), np.zeros(size), np.zeros(4)) for size in shapes]
        for batch in batches:
            values = _matrix(batch.column("x"), width)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for i in range(0, len(labels), STEP_ROWS):
                for (features, point), size, total in zip(asked, shapes, totals):
                    _add_rows(features, point, values[i:i + STEP_ROWS], labels[i:i + STEP_ROWS], size, total)
        flat = np.concatenate([np.concatenate([gram[np.triu_indices(size)], cross, pull, rest]) for size, (gram, cross, pull, rest) in zip(shapes, totals)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    total = df.mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(starts[-1])
    flat[total.column("i").to_numpy()] = total.column("v").to_numpy()
    out = []
    for size, cut, start in zip(shapes, cuts, starts):
        upper, cross, pull, square, far, n, near = np.split(flat[start:start + cut[-1] + 1], cut)
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = upper
        out.append({"gram": gram + np.triu(gram, 1).T, "cross": cross, "pull": pull, "square": square[0], "far": far[0], "n": n[0], "near": near[0]})
    return out


def _add_rows(features: FourierFeatures, point: Point | None, values: np.ndarray, r: np.ndarray, size: int, total: tuple[np.ndarray, ...]) -> None:
    gram, cross, pull, rest = total
    u = np.ones((len(r), size))
    u[:, :-1] = features.lift(values)
    rest[2] += len(r)
    if point is not None:
        weights, scale, shape = point
        r = r - u @ weights
        beyond = np.abs(r) > shape * scale
        if beyond.any():
            pull += np.where(beyond, np.sign(r), 0.0) @ u
            rest[1] += np.abs(r[beyond]).sum()
            rest[3] -= beyond.sum()
            u *= ~beyond[:, None]
            r = np.where(beyond, 0.0, r)
    gram += u.T @ u
    cross += r @ u
    rest[0] += r @ r
    rest[3] += len(r)


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares in units in which the diagonal is one: scale and weights differ in size."""
    unit = np.sqrt(np.maximum(np.diag(matrix), 0.0))
    unit[unit == 0] = 1.0
    return np.linalg.lstsq(matrix / np.outer(unit, unit), right / unit, rcond=1e-13)[0] / unit


def _least_of_model(s: dict, weights: np.ndarray, scale: float, shape: float, ridge: np.ndarray, floor: float) -> np.ndarray:
    """Weights and scale of the least loss if every row stays on its side of the bend; the sums say that without a pass."""
    moved, goal = np.zeros(len(weights)), scale
    share = s["near"] + (s["n"] - s["near"]) * (1 - shape ** 2)
    for _ in range(100):
        before = goal
        moved = _solve(s["gram"] / goal + np.diag(ridge), s["cross"] / goal + shape * s["pull"] - ridge * weights)
        square = max(s["square"] - 2 * moved @ s["cross"] + moved @ s["gram"] @ moved, 0.0)
        goal = np.sqrt(square / share) if share > 0 else np.inf
        goal = min(max(goal, floor, scale / 10), scale * 10)
        if abs(goal - before) <= 1e-12 * goal:
            break
    return np.append(weights + moved, goal)


@dataclass(frozen=True)
class KernelTask:
    """What ``fit_kernel`` takes besides the rows."""

    features: FourierFeatures
    shape: float
    penalty: float
    max_iter: int


def fit_kernels(df: DataFrame, tasks: list[KernelTask]) -> list[KernelFit]:
    """``fit_kernel`` of each task; a pass over the rows serves all fits that are not done."""
    steps, out = [_fitting(t.features, t.shape, t.penalty, t.max_iter) for t in tasks], [None] * len(tasks)
    points = {i: next(step) for i, step in enumerate(steps)}
    while points:
        found = _sums(df, [(tasks[i].features, point) for i, point in points.items()])
        following = {}
        for i, sums in zip(points, found):
            try:
                following[i] = steps[i].send(sums)
            except StopIteration as end:
                out[i] = end.value
        points = following
    return out


def fit_kernel(df: DataFrame, features: FourierFeatures, shape: float, penalty: float, max_iter: int) -> KernelFit:
    """The least sum over the rows (``x`` an array, ``label``) of the Huber loss with its scale, and the penalty on the weights.

    The loss of a residual r at the scale s is (s + r r / s) / 2 up to abs(r) = shape s and (s + 2 shape abs(r) - shape shape s) / 2
    beyond. The start is the ridge solution; a step that does not descend is halved. ``max_iter`` bounds the passes.
    """
    return fit_kernels(df, [KernelTask(features, shape, penalty, max_iter)])[0]


def _fitting(features: FourierFeatures, shape: float, penalty: float, max_iter: int) -> Generator[Point | None, dict, KernelFit]:
    """The steps of a fit: yields the point at which it needs the sums, and is sent them."""
    size = len(features.offsets) + 1
    ridge = np.append(np.full(size - 1, penalty), 0.0)
    first = yield None
    n = max(first["n"], 1.0)
    weights = _solve(first["gram"] + np.diag(ridge), first["cross"])
    least = first["square"] - 2 * weights @ first["cross"] + weights @ first["gram"] @ weights
    spread = first["square"] / n - (first["cross"][-1] / n) ** 2
    floor = 1e-6 * np.sqrt(max(spread, 0.0)) or 1e-12  # an exact fit has no scale
    scale = max(np.sqrt(max(least, 0.0) / n), floor)
    passes, step, share = 1, None, 1.0
    best = (np.inf, weights, scale)
    while passes < max(max_iter, 2):
        s = yield weights, scale, shape
        passes += 1
        beyond = s["n"] - s["near"]
        loss = (s["near"] * scale + s["square"] / scale + beyond * scale * (1 - shape ** 2) + 2 * shape * s["far"]
                + ridge @ weights ** 2) / 2
        if not loss < best[0] + 1e-12 * abs(best[0]):
            share /= 2
            if share < 1e-3:
                break
            weights, scale = best[1] + share * step[:-1], best[2] + share * step[-1]
            continue
        best, share = (loss, weights, scale), 1.0
        slope = np.append(-s["cross"] / scale - shape * s["pull"] + ridge * weights,
                          (s["near"] - s["square"] / scale ** 2 + beyond * (1 - shape ** 2)) / 2)
        step = _least_of_model(s, weights, scale, shape, ridge, floor) - np.append(weights, scale)
        if not -(slope @ step) > 2 * TOLERANCE * abs(loss):
            break
        weights, scale = best[1] + step[:-1], best[2] + step[-1]
    _, weights, scale = best if np.isfinite(best[0]) else (0.0, weights, scale)
    return KernelFit(features, weights[:-1], float(weights[-1]), float(scale), passes)
