"""Distances of rows, lines, volatility and seasons against plain versions."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from tidewatch.operators import detectors, distances, features, seasons
from tidewatch.plans import bench


def plain_knots(x, limit):
    out, s, p = [0], 0, 2
    while p < len(x):
        if abs(x[p] - (x[s] + (x[s + 1] - x[s]) * (p - s))) >= limit:
            out.append(p)
            s, p = p, p + 2
        else:
            p += 1
    return out


def plain_gap(x, y, limit):
    def value(v, own, p):
        s = max(k for k in own if k <= p)
        return v[p] if s == p else v[s] + (v[s + 1] - v[s]) * (p - s)

    a, b = plain_knots(x, limit), plain_knots(y, limit)
    every = sorted({*a, *b})
    return sum(abs(value(x, a, p) - value(y, b, p)) for p in every) / len(every)


def test_lines_of_rows(spark):
    rng = random.Random(3)
    rows = []
    for n in (2, 3, 4, 9, 40):
        for _ in range(6):
            rows.append(tuple([round(rng.gauss(0, 1), 3) for _ in range(n)] for _ in range(2)))
    got = distances.line_distance(spark.createDataFrame([*rows, ([1.0], [2.0]), (None, [1.0])], "a array<double>, b array<double>"), 1.0).collect()
    for r in got[:-2]:
        assert r.distance == pytest.approx(plain_gap(r.a, r.b, 1.0))
    assert got[-1].distance is None and got[-2].distance is None


def test_variances_are_those_of_the_recursion():
    rng = np.random.default_rng(4)
    r = rng.normal(size=(5, 90))
    omega, alpha, beta = rng.uniform(0.1, 1, 5), rng.uniform(0, 0.4, 5), rng.uniform(0, 0.5, 5)
    got = distances.variances(r, omega, alpha, beta)
    for row, w, a, b, h in zip(r, omega, alpha, beta, got):
        weights = [0.94**i for i in range(75)]
        before = sum(x * y * y for x, y in zip(weights, row)) / sum(weights)
        now = w + (a + b) * before
        for t in range(90):
            assert h[t] == pytest.approx(now)
            now = w + a * row[t] ** 2 + b * now


def test_volatility_is_found_again():
    """Simulated rows: the likelihood found is no less than that of the parameters they were made with, and no step improves it."""
    rng = np.random.default_rng(5)
    n, true = 1_500, (0.2, 0.15, 0.7)
    r, h = np.zeros((4, n)), np.full(4, 1.0)
    for t in range(n):
        r[:, t] = rng.normal(size=4) * np.sqrt(h)
        h = true[0] + true[1] * r[:, t] ** 2 + true[2] * h
    found = distances.fitted_volatility(r)
    least = distances.loss(r, *found)
    assert (least <= distances.loss(r, *(np.full(4, p) for p in true)) + 1e-9).all()
    assert np.abs(found[1] + found[2] - 0.85).max() < 0.1
    for axis in range(3):
        for side in (0.98, 1.02):
            moved = [p * (side if i == axis else 1) for i, p in enumerate(found)]
            assert (distances.loss(r, *moved) >= least - 1e-3).all()
    assert distances.garch(r[:, :50], r[:, :50]).tolist() == [0.0] * 4


def test_rows_of_any_lengths(spark):
    rows = [([0.0, 1.0], [1.0]), (None, [1.0]), ([], [1.0]), ([0.0, 1.0], [1.0]), ([3.0], [1.0])]
    got = [r.distance for r in features.sequence_distance(spark.createDataFrame(rows, "a array<double>, b array<double>"), "dtw").collect()]
    assert [None if g is None or math.isnan(g) else g for g in got] == [1.0, None, None, 1.0, 2.0]
    x, y = np.array([[0.0, 1.0, 5.0]]), np.array([[0.0, 1.0, 2.0]])
    assert distances.edit_on_reals(x, y, None).tolist() == [0.0]  # three deviations of the differences: 3 * sqrt(9 / 2)


def test_covariance_of_differences(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)), rng.normal(size=(300, 3))
    rows = [("s", i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    got = distances.covariance_distance(spark.createDataFrame(rows, "series_id string, idx long, a array<double>, b array<double>").repartition(5)).orderBy("idx").collect()
    inverse = np.linalg.inv(np.cov(a - b, rowvar=False))
    assert np.allclose([r.distance for r in got], np.sqrt(np.einsum("ij,jk,ik->i", a - b, inverse, a - b)))


@pytest.mark.parametrize("period", [5, 6])
def test_decomposition_is_the_plain_one(spark, monkeypatch, period):
    rng = np.random.default_rng(7)
    n = 63
    v = np.arange(n) * 0.3 + np.tile(rng.normal(size=period), 20)[:n] + rng.normal(0, 0.1, n)
    half = period // 2
    weights = np.ones(2 * half + 1) / period
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(v, weights, "valid")
    at = np.arange(n)
    for side, near in ((at < half, at[half : half + period]), (at >= n - half, at[n - half - period : n - half])):
        trend[side] = np.polyval(np.polyfit(near, trend[near], 1), at[side])
    means = np.array([(v - trend)[i::period].mean() for i in range(period)])
    season = (means - means.mean())[at % period]
    monkeypatch.setattr("tidewatch.operators.segments.BUCKET", 16)
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("short", i, 1.0) for i in range(period)], "series_id string, idx long, value double")
    got = seasons.decompose(rows, period)
    own = got.filter("series_id = 'a'").orderBy("idx").collect()
    assert np.allclose([r.trend for r in own], trend) and np.allclose([r.seasonal for r in own], season) and np.allclose([r.residual for r in own], v - trend - season)
    assert got.filter("series_id = 'short' AND trend IS NULL AND residual IS NULL").count() == period
    ends = seasons.decompose(rows, period, extrapolate=False).filter("series_id = 'a' AND trend IS NULL").count()
    assert ends == 2 * half


def test_cliques_of_random_graphs():
    for seed in range(25):
        rng = random.Random(seed)
        n = rng.randrange(1, 10)
        names = [f"d{i}" for i in range(n)]
        apart = {p for p in combinations(names, 2) if rng.random() < 0.5}
        alike = [set(g) for k in range(1, n + 1) for g in combinations(names, k) if not any(p in apart for p in combinations(g, 2))]
        want = {tuple(sorted(g)) for g in alike if len(g) > 1 and not any(g < h for h in alike)}
        assert set(bench.cliques(names, apart)) == want
    # Not a run of the ranking: the first and the last are alike, the middle differs from both.
    assert bench.cliques("abc", {("a", "b"), ("b", "c")}) == [("a", "c")]
    everyone = (1 << 64) - 1
    assert bench.maximal_cliques([everyone & ~(1 << i) for i in range(64)]) == [everyone]
    with pytest.raises(ValueError):
        bench.maximal_cliques([0] * 65)


def test_confidence_at_any_size(spark):
    from math import comb

    for n, least, x in ((10, 3, 0.2), (40, 36, 0.9), (300, 1, 0.01), (500, 451, 0.95)):
        want = sum(comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(least, n + 1))
        assert features.beta_share(np.array([x]), least, n - least + 1)[0] == pytest.approx(want, rel=1e-9)
    assert features.beta_share(np.array([0.9, 0.95]), 9e5, 1e5 + 1)[1] == pytest.approx(1)


def test_confidence_of_millions(spark):
    """Only ranks near the limit are worked out, in some hundred steps, to twelve digits; sums of logarithms by fsum are the plain version."""
    from math import exp, fsum, log, log1p
    from time import process_time

    n = 1_200_000
    least, began = n - n // 10 + 1, process_time()
    got = features.chance_of_more(np.arange(1.0, n + 1), n, 0.1)
    assert process_time() - began < 20 and got[0] == 0 and got[-1] == 1 and (np.diff(got) > -1e-12).all()
    for rank in (least - 300, least, least + 200):
        x, ratio, total, j = (1 + rank) / (2 + n), 1.0, [], least
        while ratio > 1e-20:  # chances from the limit up, by the first
            total.append(ratio)
            ratio, j = ratio * (n - j) / (j + 1) * x / (1 - x), j + 1
        first = fsum([log(v) for v in range(least + 1, n + 1)] + [-log(v) for v in range(1, n - least + 1)] + [least * log(x), (n - least) * log1p(-x)])
        assert got[rank - 1] == pytest.approx(exp(first) * fsum(total), abs=1e-10)
    rows = spark.createDataFrame([(s, i, float(i % 4)) for s in "ab" for i in range(200)], "series_id string, idx long, score double")
    out = {(r.series_id, r.score): r.confidence for r in features.confidence(rows).collect()}
    assert len(out) == 8 and features.confidence(rows).columns == ["series_id", "idx", "score", "confidence"] and features.confidence(rows).count() == 400


@pytest.mark.parametrize("metric, apart, past", [("euclidean", 0, False), ("euclidean", 3, False), ("manhattan", 0, True)])
def test_points_are_written_once_for_all_blocks(spark, monkeypatch, metric, apart, past):
    """Nearest points over many blocks, with copies, ties and far-off values, from blocks that hold each point once."""
    rng, written = np.random.default_rng(0), []
    x = np.vstack([rng.integers(0, 3, size=(80, 4)).astype(float), rng.normal(size=(40, 4)) + 1_000, np.ones((40, 4))])
    monkeypatch.setattr(detectors, "BLOCK", 50)
    monkeypatch.setattr(detectors, "HELD", 3_000)
    cut = detectors.materialise
    monkeypatch.setattr(detectors, "materialise", lambda df: written.append(cut(df)) or written[-1])
    rows = spark.createDataFrame([(s, i, v.tolist()) for s in "ab" for i, v in enumerate(x)], "series_id string, idx long, v array<double>")
    got = {}
    for r in detectors.neighbours(rows, 4, apart, past, metric).orderBy("idx", "rank").collect():
        got.setdefault((r.series_id, r.idx), []).append((r.other, pytest.approx(r.dist)))
    far = lambda i, j: float(((x[i] - x[j]) ** 2).sum() ** 0.5 if metric == "euclidean" else np.abs(x[i] - x[j]).sum())
    for i in range(160):
        want = [(j, d) for d, j in sorted((far(i, j), j) for j in range(160) if abs(i - j) > apart and i != j and (j < i or not past))[:4]]
        assert got.get(("a", i), []) == got.get(("b", i), []) == want
    (blocks,) = (w.collect() for w in written)
    assert len(blocks) == 8 and sum(b.n for b in blocks) == 320 and sum(len(b.v) for b in blocks) == 320 * 32
    assert (sum(b.m for b in blocks) < 320) == (apart == 0 and not past)


def test_connectivity_factor_from_neighbours_written_once(spark, monkeypatch):
    x, k, written = np.random.default_rng(5).normal(size=(60, 3)).round(1), 5, []
    cut = detectors.materialise
    monkeypatch.setattr(detectors, "materialise", lambda df: written.append(1) or cut(df))
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, idx long, v array<double>")
    far = lambda i, j: float(((x[i] - x[j]) ** 2).sum() ** 0.5)
    near = [[j for _, j in sorted((far(i, j), j) for j in range(60) if j != i)[:k]] for i in range(60)]
    cost = [sum(2 * (k - h) / ((k + 1) * k) * min(far(i, j), *(far(e, j) for e in near[i][:h])) if h else 2 / (k + 1) * far(i, j) for h, j in enumerate(near[i])) for i in range(60)]
    got = {r.idx: r.score for r in detectors.cof(rows, k).collect()}
    assert got == {i: pytest.approx(k * cost[i] / sum(cost[j] for j in near[i])) for i in range(60)} and len(written) == 2
    assert detectors.lof(rows, k).count() == 60 and len(written) == 4
