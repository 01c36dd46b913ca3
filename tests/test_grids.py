"""Parameters of detectors: kernels, metrics, shares of columns and variance, tuned values; areas by a share of runs."""

import numpy as np
import pytest

from tidewatch.operators import detectors, kernels, measures, models
from tidewatch.plans import bench
from tidewatch.plans.registry import REGISTRY, detect


@pytest.mark.parametrize("kernel", ["rbf", "linear", "poly", "sigmoid"])
@pytest.mark.parametrize("nu", [0.1, 0.5])
def test_one_class_meets_its_conditions(kernel, nu):
    """At most a share nu of the points lies outside, and at least that share has a weight."""
    x = np.random.default_rng(1).normal(size=(200, 3)) + 3
    scores = kernels.one_class(x, nu=nu, kernel=kernel)
    assert np.isfinite(scores).all() and (scores > 1e-2 * max(np.abs(scores).max(), 1)).mean() <= nu + 0.02
    if kernel == "rbf":
        far = kernels.one_class(np.vstack([x, [[30, 30, 30]]]), np.arange(200), nu, kernel)
        assert far[-1] == far.max()
    with pytest.raises(ValueError, match="no kernel"):
        kernels.one_class(x, kernel="cosine")


def points(spark, x):
    return spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, idx long, v array<double>")


def test_neighbours_by_absolute_differences(spark, monkeypatch):
    monkeypatch.setattr(detectors, "BLOCK", 20)
    x = np.round(np.random.default_rng(2).normal(size=(70, 3)), 2)
    got = detectors.neighbours(points(spark, x), 4, metric="manhattan").orderBy("idx", "rank").collect()
    d = np.abs(x[:, None] - x[None]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert np.allclose([r.dist for r in got], np.sort(d, axis=1)[:, :4].ravel())
    with pytest.raises(ValueError, match="no metric"):
        detectors.neighbours(points(spark, x), 4, metric="cosine")


def test_components_by_share_of_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1)) @ rng.normal(size=(1, 4)) + rng.normal(0, 0.3, size=(400, 4))
    for share in (0.25, 0.75, 0.97):
        values = fitted_values(spark, x, share)
        every = fitted_values(spark, x, None)
        assert len(values) == int(np.searchsorted(np.cumsum(every) / every.sum(), share, "right")) + 1


def fitted_values(spark, x, keep):
    from tidewatch.operators.plain import unpack

    return unpack(models.principal.fit(points(spark, x), keep=keep).first()["model"])[3]


def test_trees_of_a_share_of_columns(spark):
    from tidewatch.operators.plain import unpack

    x = np.random.default_rng(4).normal(size=(300, 5))
    forest, _ = unpack(models.isolation.fit(points(spark, x), columns=0.4, trees=10).first()["model"])
    assert all(len({c for c in tree[0].tolist() if c >= 0}) <= 2 for tree in forest)


def test_tuned_values_and_grids_name_parameters():
    for channels, table in ((False, bench.GRIDS), (True, bench.CHANNEL_GRIDS)):
        for name, grid in table.items():
            assert set(grid) - {"period_rank"} <= set(REGISTRY[name].params), name
            assert len(bench.combinations_of(name, channels)) == np.prod([len(v) for v in grid.values()])
    for table in (bench.TUNED, bench.CHANNELS_TUNED):
        for name, params in table.items():
            assert set(params) - {"period_rank"} <= set(REGISTRY[name].params), name
    assert len(bench.combinations_of("OCSVM", channels=True)) == 16 and bench.combinations_of("FFT") == [{}]


def test_detection_with_tuned_values(spark):
    v = np.sin(np.arange(240) * 2 * np.pi / 12) + np.random.default_rng(5).normal(0, 0.05, 240)
    series = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "series_id string, idx long, value double")
    assert bench.detect_tuned(series, "Sub_PCA").filter("score IS NOT NULL").count() == 240
    rows = spark.createDataFrame([("c", i, [float(x), float(-x), 1.0]) for i, x in enumerate(v)], "series_id string, idx long, features array<double>")
    assert bench.detect_tuned(rows, "OCSVM").filter("score IS NOT NULL").count() == 240
    assert detect(rows, "OCSVM", kernel="linear", nu=0.3).count() == 240


def plain_share_areas(score, label, share, steps):
    n, p = len(score), label.sum()
    soft, s = label.astype(float), 0
    runs = []
    while s < n:
        if label[s]:
            e = s
            while e + 1 < n and label[e + 1]:
                e += 1
            runs.append((s, e))
            s = e
        s += 1
    for s, e in runs:
        l0 = int((e - s + 1) * share)
        for d in range(1, l0 + 1):
            for at, ok in ((s - d, True), (e + d, d < l0)):
                if ok and 0 <= at < n:
                    soft[at] += np.sqrt(1 - d / (2 * l0))
    soft = np.minimum(soft, 1)
    wide, inside = [], soft > 0
    for i in range(n):
        if inside[i] and (i == 0 or not inside[i - 1]):
            wide.append([i, i])
        if inside[i]:
            wide[-1][1] = i
    order = np.sort(score)[::-1]
    curve = [(0.0, 0.0, None)]
    for k in range(steps):
        pred = score >= order[int(k * (n - 1) / (steps - 1))]
        tp = (soft * pred).sum()
        new = np.where(label == 1, 1.0, soft * pred).sum()
        positives = (p + new) / 2
        hit = np.mean([pred[a : b + 1].any() for a, b in wide])
        curve.append((min(tp / positives, 1) * hit, (pred.sum() - tp) / (n - positives), tp / pred.sum()))
    curve.append((1.0, 1.0, None))
    roc = sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(curve, curve[1:]))
    pr = sum((b[0] - a[0]) * b[2] for a, b in zip(curve[:-1], curve[1:-1]))
    return roc, pr


def test_areas_by_a_share_of_runs(spark):
    rng = np.random.default_rng(6)
    label = np.zeros(200, int)
    for s, e in ((0, 11), (40, 54), (60, 62), (120, 139), (190, 199)):
        label[s : e + 1] = 1
    score = np.round(rng.random(200) + 0.4 * label, 2)
    rows = spark.createDataFrame([("a", i, float(x), int(y)) for i, (x, y) in enumerate(zip(score, label))], "series_id string, idx long, score double, label int")
    for share in (0.0, 0.2, 0.5):
        got = measures.range_auc_share(rows, share, 50).first()
        assert (got.range_auc_roc, got.range_auc_pr) == pytest.approx(plain_share_areas(score, label, share, 50), rel=1e-9)
