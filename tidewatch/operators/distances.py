"""Distances of two sequences, for all rows of a batch at once: arrays of rows by places in, one distance for each row out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import models as m
from tidewatch.operators.kernels import shape_correlation

#: Parameters of the volatility that a search begins with: weights of the last square and of the last variance.
SQUARES, VARIANCES = (0.01, 0.05, 0.1, 0.2, 0.4), (0.0, 0.2, 0.5, 0.7, 0.8, 0.9, 0.95)


def warp(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dynamic time warping with absolute differences."""
    above = np.full((y.shape[1] + 1, len(x)), np.inf)
    above[0] = 0
    for i in range(x.shape[1]):
        row = np.full_like(above, np.inf)
        for j in range(y.shape[1]):
            row[j + 1] = np.abs(x[:, i] - y[:, j]) + np.minimum(np.minimum(above[j + 1], row[j]), above[j])
        above = row
    return above[-1]


def edit_on_reals(x: np.ndarray, y: np.ndarray, eps: float | None = 0.1) -> np.ndarray:
    """Edits that make the sequences match within eps, over the longer length; without eps three deviations of the row's differences (of sequences of equal length)."""
    limit = np.full(len(x), eps) if eps is not None else 3 * np.sqrt(((x - y) ** 2).sum(axis=1) / max(x.shape[1] - 1, 1))
    above = np.repeat(np.arange(y.shape[1] + 1.0)[:, None], len(x), axis=1)
    for i in range(x.shape[1]):
        row = np.empty_like(above)
        row[0] = i + 1
        for j in range(y.shape[1]):
            row[j + 1] = np.minimum(np.minimum(above[j + 1], row[j]) + 1, above[j] + (np.abs(x[:, i] - y[:, j]) > limit))
        above = row
    return above[-1] / max(x.shape[1], y.shape[1], 1)


def time_warp_edit(x: np.ndarray, y: np.ndarray, gamma: float = 0.1, nu: float = 0.001) -> np.ndarray:
    """Edits of sequences with times: a gap costs gamma and the time it spans times nu."""
    x, y = (np.hstack([np.zeros((len(v), 1)), v]) for v in (x, y))
    above = np.full((y.shape[1], len(x)), np.inf)
    above[0] = 0
    for i in range(1, x.shape[1]):
        row = np.full_like(above, np.inf)
        for j in range(1, y.shape[1]):
            drop_x = above[j] + np.abs(x[:, i] - x[:, i - 1])
            drop_y = row[j - 1] + np.abs(y[:, j] - y[:, j - 1])
            both = above[j - 1] + np.abs(x[:, i] - y[:, j]) + np.abs(x[:, i - 1] - y[:, j - 1]) + 2 * nu * abs(i - j)
            row[j] = np.minimum(np.minimum(drop_x, drop_y) + nu + gamma, both)
        above = row
    return above[-1]


def mahalanobis(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the difference of two sequences, in units of the deviation of both together."""
    spread = np.hstack([x, y]).var(axis=1)
    return np.sqrt(((x - y) ** 2).sum(axis=1) / np.maximum(spread, 1e-12))


def shape(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 less the greatest normalised cross-correlation over all shifts."""
    return np.array([1 - shape_correlation(a[None], b)[0][0] for a, b in zip(x, y)])


def variances(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Conditional variances of rows of residuals: omega + alpha * the last square + beta * the last variance; before the first both are a mean of the first squares, the earlier the heavier."""
    squares = r * r
    n = min(r.shape[1], 75)
    weights = 0.94 ** np.arange(n)
    before = squares[:, :n] @ (weights / weights.sum())
    out = np.empty_like(squares)
    out[:, 0] = omega + (alpha + beta) * before
    for t in range(1, r.shape[1]):
        out[:, t] = omega + alpha * squares[:, t - 1] + beta * out[:, t - 1]
    return out


def loss(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Minus the log likelihood of normal residuals with these variances, but for a constant; infinite for parameters that are none."""
    with np.errstate(all="ignore"):
        h = variances(r, omega, alpha, beta)
        out = 0.5 * (np.log(h) + r * r / h).sum(axis=1)
    return np.where((omega > 0) & (alpha >= 0) & (beta >= 0) & (alpha + beta < 1) & np.isfinite(out), out, np.inf)


def fitted_volatility(r: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha and beta of greatest likelihood for each row: the best of a grid, then steps along the axes, half as long where none helps."""
    level = np.maximum((r * r).mean(axis=1), 1e-300)
    best, p = np.full(len(r), np.inf), np.zeros((3, len(r)))
    for a in SQUARES:
        for b in VARIANCES:
            if a + b < 1:
                tried = np.stack([level * (1 - a - b), np.full(len(r), a), np.full(len(r), b)])
                now = loss(r, *tried)
                better = now < best
                best, p = np.where(better, now, best), np.where(better, tried, p)
    step = np.stack([0.5 * p[0], np.full(len(r), 0.05), np.full(len(r), 0.1)])
    for _ in range(rounds):
        moved = np.zeros(len(r), bool)
        for axis in range(3):
            for side in (1, -1):
                tried = p.copy()
                tried[axis] = np.maximum(tried[axis] + side * step[axis], 0)
                now = loss(r, *tried)
                better = now < best
                best, p, moved = np.where(better, now, best), np.where(better, tried, p), moved | better
        step = np.where(moved, step, step / 2)
    return tuple(p)


def garch(x: np.ndarray, y: np.ndarray, scale: float = 10.0, params: tuple[float, float, float] | None = None) -> np.ndarray:
    """Mean of the absolute differences, each over the deviation that a GARCH(1, 1) recursion of the row's (scaled) differences gives it; at given parameters or those of greatest likelihood."""
    r = scale * (x - y)
    flat = ~r.any(axis=1)
    p = tuple(np.full(len(r), v) for v in params) if params else fitted_volatility(np.where(flat[:, None], 1.0, r))
    deviation = np.sqrt(variances(r, *p)) / scale
    return np.where(flat, 0.0, (np.abs(x - y) / np.where(deviation > 0, deviation, np.inf)).mean(axis=1))


#: Distances by name.
BATCH: dict[str, Callable[..., np.ndarray]] = {"dtw": warp, "edr": edit_on_reals, "twed": time_warp_edit, "mahalanobis": mahalanobis, "sbd": shape, "garch": garch}


def batched(how: Callable[..., np.ndarray], a: pd.Series, b: pd.Series, **params) -> pd.Series:
    """The distances of rows; those of the same two lengths at once.  Null where one is null or empty."""
    out = np.full(len(a), np.nan)
    x, y = ([None if v is None else np.asarray(v, float) for v in side] for side in (a, b))
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (p, q) in enumerate(zip(x, y)):
        if p is not None and q is not None and len(p) and len(q):
            kinds.setdefault((len(p), len(q)), []).append(i)
    for rows in kinds.values():
        out[rows] = how(np.stack([x[i] for i in rows]), np.stack([y[i] for i in rows]), **params)
    return pd.Series(out)


def knots(x: str | Column, limit: float) -> Column:
    """Places where a line through a knot and the value after it has left the values by ``limit`` or more, from the second value after the knot on; the first place is a knot."""
    x = F.col(x) if isinstance(x, str) else x
    start = F.struct(F.lit(0).alias("knot"), F.array(F.lit(0)).alias("all"))

    def on(state: Column, p: Column) -> Column:
        at = state["knot"]
        slope = F.get(x, at + 1) - F.get(x, at)
        away = F.abs(F.get(x, p) - (F.get(x, at) + slope * (p - at)))
        new = (p >= at + 2) & (away >= limit)
        return F.when(new, F.struct(p.alias("knot"), F.array_append(state["all"], p).alias("all"))).otherwise(state)

    places = F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, on, lambda state: state["all"])


def line_gap(a: str, b: str, limit: float = 1.0) -> Column:
    """Mean difference of two sequences of equal length at all knots of both: of their values where they have a knot, else of their lines; null for sequences of one value."""

    def value(x: str, own: str, p: Column) -> Column:
        at = F.array_max(F.filter(own, lambda k: k <= p))
        return F.when(at == p, F.get(x, p)).otherwise(F.get(x, at) + (F.get(x, at + 1) - F.get(x, at)) * (p - at))

    every = F.array_union("_knots_a", "_knots_b")
    gaps = F.transform(every, lambda p: F.abs(value(a, "_knots_a", p) - value(b, "_knots_b", p)))
    return F.when(F.size(a) > 1, F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / F.size(gaps))


def line_distance(pairs: DataFrame, limit: float = 1.0) -> DataFrame:
    """Add distance: the gap of the lines that array columns a and b are cut into."""
    cut = pairs.withColumn("_knots_a", knots("a", limit)).withColumn("_knots_b", knots("b", limit))
    return cut.withColumn("distance", line_gap("a", "b", limit)).drop("_knots_a", "_knots_b")


def _inverse(total: m.Model) -> m.Model:
    n, s, ss = total
    mean = s / n
    return mean, np.linalg.pinv((ss - n * np.outer(mean, mean)) / max(n - 1, 1))


def covariance_distance(pairs: DataFrame) -> DataFrame:
    """series_id, idx and distance: the length of the differences a - b in units of the covariance of all differences of the series, which sums of outer products give."""
    points = pairs.select("series_id", "idx", F.zip_with("a", "b", lambda x, y: x - y).alias("v"))
    models = m.fit(points, m._moments, m._add, _inverse)
    found = m.score(points, models, lambda model, v: np.sqrt(np.maximum(np.einsum("ij,ij->i", v @ model[1], v), 0)))
    return found.withColumnRenamed("score", "distance")
