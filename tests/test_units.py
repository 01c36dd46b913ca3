"""Hand-sized cases and plain versions of what SQL can't check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors, features, frames, kernels, measures, models, segments
from tidewatch.operators import period as periods
from tidewatch.plans import bench, registry
from tidewatch.plans.registry import REGISTRY, detect, register
from tidewatch.sources import series as sources
from tidewatch.streaming import features as streams


def points(spark, labels, scores=None, name="a"):
    scores = scores if scores is not None else [0.0] * len(labels)
    return spark.createDataFrame([(name, i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))], "series_id string, idx long, score double, label int")


def test_runs(spark):
    rows = segments.runs(points(spark, [0, 1, 1, 0, 0, 1, 0])).orderBy("s").collect()
    assert [(r.s, r.e) for r in rows] == [(1, 2), (5, 5)]


def test_merged_runs_touch(spark):
    labels = [int(10 <= i <= 12 or 16 <= i <= 18) for i in range(25)]
    rows = measures.merged_runs(points(spark, labels), 4).collect()
    assert [(r.s, r.e) for r in rows] == [(8, 20)]


def test_soft_labels(spark):
    p = points(spark, [int(10 <= i <= 12) for i in range(20)])
    soft = {r.idx: r.soft for r in segments.soft_labels(p, segments.runs(p), 4).collect()}
    assert soft[10] == soft[12] == 1 and soft[9] == soft[13] == pytest.approx((1 - 1 / 4) ** 0.5) and soft[8] == pytest.approx(0.5**0.5) and soft[7] == 0


@pytest.mark.parametrize("sign, want", [(1, 1.0), (-1, 0.0)])
def test_perfect_and_reverse_scores(spark, sign, want):
    labels = [0, 1, 1, 0, 0, 1, 0]
    p = points(spark, labels, [sign * y for y in labels])
    assert measures.roc_auc(p).first().auc_roc == want
    if sign > 0:
        assert measures.average_precision(p).first().auc_pr == 1


def test_labels_of_one_kind_give_null(spark):
    out = measures.evaluate(points(spark, [0, 0, 0, 0], [1, 2, 3, 4]), 2).first()
    assert out.auc_roc is None and out.vus_pr is None


def test_constant_series_has_zero_scores(spark):
    c = spark.createDataFrame([("a", i, 3.0) for i in range(5)], "series_id string, idx long, value double")
    assert {r.value for r in frames.zscore(c).collect()} == {0.0}


def test_name_metadata(spark):
    names = spark.createDataFrame([("001_NAB_id_1_Facility_tr_1007_1st_2014.csv",), ("870_OPPORTUNITY_id_29_HumanActivity_tr_1477_1st_1577.csv",)], "file_name string")
    rows = sources.name_metadata(names).orderBy("series_no").collect()
    assert [(r.dataset, r.domain, r.train_index, r.first_anomaly) for r in rows] == [("NAB", "Facility", 1007, 2014), ("OPPORTUNITY", "HumanActivity", 1477, 1577)]


def plain_range_areas(label, score, width, steps=250):
    """Window by window and threshold by threshold."""
    n, rocs, prs = len(label), [], []
    edge = np.diff(np.r_[0, label, 0])
    runs = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1))
    order = np.sort(score)[::-1]
    for w in range(width + 1):
        h, soft = w // 2, label.astype(float)
        for s, e in runs:
            for i in range(n):
                if e < i <= e + h:
                    soft[i] += np.sqrt(1 - (i - e) / w)
                if s - h <= i < s:
                    soft[i] += np.sqrt(1 - (s - i) / w)
        soft = np.minimum(soft, 1)
        wide = []
        for s, e in runs:
            if wide and not wide[-1][1] + h < s - h:
                wide[-1][1] = e
            else:
                wide.append([s, e])
        cells = [(0.0, 0.0, 0.0)]
        for k in range(steps):
            hit = score >= order[int(k * (n - 1) / (steps - 1))]
            tp = (soft * hit).sum()
            p = (label.sum() + (np.where(label == 1, 1, soft * hit)).sum()) / 2
            exist = np.mean([hit[max(s - h, 0) : e + h + 1].any() for s, e in wide])
            cells.append((min(tp / p, 1) * exist, (hit.sum() - tp) / (n - p), tp / hit.sum()))
        t, f, pr = map(np.array, zip(*cells))
        t2, f2 = np.r_[t, 1], np.r_[f, 1]
        rocs.append((np.diff(f2) * (t2[1:] + t2[:-1]) / 2).sum())
        prs.append((np.diff(t) * pr[1:]).sum())
    return np.mean(rocs), np.mean(prs)


@pytest.mark.parametrize("seed", range(3))
def test_volume_is_that_of_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    label = (rng.random(90) < 0.1).astype(int)
    label[:2] = label[-1] = seed == 0
    label[40:45] = 1
    score = np.round(rng.random(90) + 0.4 * label, 2)
    got = measures.volume_under_surface(points(spark, label, score), 7).first()
    assert (got.vus_roc, got.vus_pr) == pytest.approx(plain_range_areas(label, score, 7))


def plain_affiliation(label, pred, fine=400):
    """Precision and recall probabilities by sampling the time axis."""
    n = len(label)
    runs = lambda v: list(zip(np.flatnonzero(np.diff(np.r_[0, v, 0]) == 1), np.flatnonzero(np.diff(np.r_[0, v, 0]) == -1)))
    truth, found = runs(label), runs(pred)
    bounds = [0, *[(a[1] + b[0]) / 2 for a, b in zip(truth, truth[1:])], n]
    precisions, recalls = [], []
    for (j0, j1), z0, z1 in zip(truth, bounds, bounds[1:]):
        cut = [(max(a, z0), min(b, z1)) for a, b in found if a < z1 and b > z0]
        if not cut:
            recalls.append(0)
            continue
        size, total, length = z1 - z0, 0.0, 0.0
        chance = lambda d, t: 1 - (np.minimum(d, t - z0) + np.minimum(d, z1 - t)) / size
        for a, b in cut:
            t = a + (np.arange(fine) + 0.5) * (b - a) / fine
            d = np.maximum(np.maximum(j0 - t, t - j1), 0)
            spread = (np.minimum(d, j0 - z0) + np.minimum(d, z1 - j1) + (j1 - j0)) / size  # how much of the zone is as near
            total += np.where(d == 0, 1, 1 - spread).mean() * (b - a)
            length += b - a
        precisions.append(total / length)
        t = j0 + (np.arange(fine * 4) + 0.5) * (j1 - j0) / (fine * 4)
        d = np.min([np.maximum(np.maximum(a - t, t - b), 0) for a, b in cut], axis=0)
        recalls.append(chance(d, t).mean())
    return np.mean(precisions), np.mean(recalls)


@pytest.mark.parametrize("seed", range(3))
def test_affiliation_is_that_of_sampling(spark, seed):
    rng = np.random.default_rng(seed)
    label = np.zeros(80, int)
    label[10:14] = label[30:31] = label[55:65] = 1
    pred = (rng.random(80) < 0.08).astype(int)
    pred[28:29] = 1
    p = points(spark, label).withColumn("pred", F.element_at(F.array(*[F.lit(int(x)) for x in pred]), (F.col("idx") + 1).cast("int")))
    got = measures.affiliation_of_predictions(p).first()
    assert (got.affiliation_precision, got.affiliation_recall) == pytest.approx(plain_affiliation(label, pred), abs=2e-3)


def test_periods(spark):
    x = [np.sin(2 * np.pi * i / 25) for i in range(400)]
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx long, value double")
    assert periods.period(rows).first().period == 25
    assert periods.period(rows, 0).first().period == 1
    assert periods.spectrum_periods(rows, 1).first().period == 25


@pytest.mark.parametrize("n", [1, 2, 7, 36, 97, 120])
def test_spectrum(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(name, i, float(v)) for name, s in (("a", x), ("b", x[::-1])) for i, v in enumerate(s)], "series_id string, idx long, value double")
    got = {(r.series_id, r.freq): r.amplitude for r in periods.spectrum(rows).collect()}
    want = {(name, f): abs(np.fft.fft(s)[f]) for name, s in (("a", x), ("b", x[::-1])) for f in range(1, n // 2 + 1)}
    assert got == pytest.approx(want)


def test_correlations_of_all_points(spark):
    x = np.sin(np.arange(300) * (1 + (np.arange(300) > 150)))
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx long, value double")
    for points in (150, None):
        z = x[:points] - x[:points].mean()
        got = {r.lag: r.acf for r in periods.acf(rows, 20, points).collect()}
        assert got == pytest.approx({k: float((z[: len(z) - k] * z[k:]).sum() / (z * z).sum()) for k in range(21)})


def spike(spark, n=300, at=200):
    rng = np.random.default_rng(0)
    v = np.sin(np.arange(n) / 4) + 0.05 * rng.normal(size=n)
    v[at : at + 8] += 3
    return spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "series_id string, idx long, value double")


@pytest.mark.parametrize("name, params", [("Sub_IForest", {"width": 20}), ("Sub_PCA", {"width": 20}), ("Sub_OCSVM", {"width": 20}), ("Sub_MCD", {"width": 5}), ("Sub_KNN", {"width": 20}), ("Sub_LOF", {"width": 20}), ("Sub_HBOS", {"width": 20}), ("AutoEncoder", {"width": 20}), ("LinearForecast", {"width": 30}), ("FITS", {"width": 20}), ("Seasonal", {"width": 25}), ("DetrendedMean", {"width": 10}), ("POLY", {"width": 20}), ("MatrixProfile", {"width": 20}), ("KMeansAD", {"width": 20})])
def test_detectors_find_a_spike(spark, name, params):
    rows = detect(spike(spark), name, **params).collect()
    score = np.array([r.score for r in sorted(rows, key=lambda r: r.idx)])
    assert len(score) == 300 and np.isfinite(score).all()
    assert score[190:220].mean() > np.delete(score, np.s_[180:230]).mean()


def test_online_shapes_know_only_the_past(spark):
    """Scores of SAND don't depend on later batches, those of KShapeAD do."""
    t = np.arange(1200)
    v = np.where(t < 900, np.sin(t / 4), np.abs(t % 40 - 20) / 10) + 0.1 * np.random.default_rng(0).normal(size=1200)
    other = np.where(t < 900, v, v[::-1])
    rows = spark.createDataFrame([(name, i, float(x)) for name, s in (("a", v), ("b", other)) for i, x in enumerate(s)], "series_id string, idx long, value double")
    got = {}
    for name in ("SAND", "KShapeAD"):
        scores = {(r.series_id, r.idx): r.score for r in detect(rows, name, width=20).collect()}
        a, b = (np.array([scores[s, i] for i in range(1200)]) for s in "ab")
        assert np.isfinite(a).all() and np.isfinite(b).all()
        # 360 points at first, then 120 at a time; sub-sequences reach 80 points beyond their batch.
        got[name] = np.allclose(a[:720], b[:720]) and not np.allclose(a[900:], b[900:])
    assert got == {"SAND": True, "KShapeAD": False}


def test_one_class_fits_all_points():
    """No sample: over 500 points, scores don't depend on the order of the points."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(2970, 2)), rng.normal(8, 0.1, size=(30, 2))])
    score = kernels.one_class(x)
    assert np.abs(kernels.one_class(x[::-1])[::-1] - score).max() < 1e-4 * np.ptp(score)
    assert (score > 0).mean() == pytest.approx(0.5, abs=0.01)


def test_one_class_is_fitted_on_the_training_part(spark):
    x = np.random.default_rng(0).normal(size=(600, 3))
    other = np.vstack([x[:300], x[300:] ** 3])
    rows = spark.createDataFrame([(name, i, f.tolist()) for name, s in (("a", x), ("b", other)) for i, f in enumerate(s)], "series_id string, idx long, features array<double>")
    scores = {(r.series_id, r.idx): r.score for r in detect(rows, "OCSVM").collect()}
    assert np.allclose(*([scores[s, i] for i in range(300)] for s in "ab"))


def test_robust_principal_components(spark):
    """Differences between the low-rank part and its components, of channels as they are, with the rounds of the reference."""
    load = np.append(np.linspace(1, 2, 8), 0)
    x = np.outer(np.sin(np.arange(200) / 9) + 2, load)
    rows = spark.createDataFrame([("a", i, f.tolist()) for i, f in enumerate(x)], "series_id string, idx long, features array<double>")
    got = np.array([r.score for r in detect(rows, "RobustPCA").orderBy("idx").collect()])
    # The low-rank part is x itself; only its first component has variance.
    first = (x - x.mean(axis=0)) @ load / np.linalg.norm(load)
    assert np.allclose(got, np.abs(x[:, 0] - first) + np.abs(x[:, 1:]).sum(axis=1), atol=1e-3)
    assert REGISTRY["RobustPCA"].params["rounds"] == 1000


def test_registry(spark):
    assert len(REGISTRY) == 50
    with pytest.raises(ValueError, match="not available"):
        detect(spike(spark), "NORMA")
    with pytest.raises(ValueError, match="no parameter"):
        detect(spike(spark), "SR", wrong=1)
    register("Mine", lambda s: s.select("series_id", "idx", F.abs("value").alias("score")))
    assert detect(spike(spark), "Mine").count() == 300
    del REGISTRY["Mine"]


def test_errors_stay_with_their_series(spark):
    both = spike(spark).unionByName(spark.createDataFrame([("b", 0, 1.0)], "series_id string, idx long, value double"))
    for name, params in (("SAND", {}), ("Sub_PCA", {"width": 20}), ("Sub_OCSVM", {"width": 20})):
        rows = detect(both, name, **params).groupBy("series_id").agg(F.max("error").alias("error"), F.count("*").alias("n")).collect()
        assert {r.series_id: (r.error is None, r.n) for r in rows} == {"a": (True, 300), "b": (False, 1)} or name == "Sub_OCSVM"


def test_cluster_factor(spark, monkeypatch):
    """Large clusters by coverage; the point of a small one is scored by the nearest large centre."""
    x = [0.0] * 40 + [1.0] * 40 + [9.0] * 4
    p = spark.createDataFrame([("a", i, [v]) for i, v in enumerate(x)], "series_id string, idx long, v array<double>")
    out = {r.idx: r.score for r in models.cluster_factor(p, clusters=3, alpha=0.9).collect()}
    assert out[0] == out[50] == 0 and out[82] == pytest.approx(8)


def cloud(spark, n=3_000):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]]) + rng.integers(0, 3, size=(n, 1)) * 6
    x[::100] += rng.normal(size=(n // 100, 3)) * 8
    rows = spark.createDataFrame([(name, i, (v * s).tolist()) for name, s in (("a", 1), ("b", 2)) for i, v in enumerate(x)], "series_id string, idx long, v array<double>")
    return x, rows.repartition(6)


def scores_of(df, name="a"):
    return np.array([r.score for r in df.filter(F.col("series_id") == name).orderBy("idx").collect()])


@pytest.fixture
def in_parts(monkeypatch):
    """Series come in several buckets and are larger than the pool."""
    monkeypatch.setattr(models, "POOL", 500)
    monkeypatch.setattr(segments, "BUCKET", 700)


def test_principal_components_of_all_points(spark, in_parts):
    x, rows = cloud(spark)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z, rowvar=False))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(3)])
    want = sum(np.linalg.norm(z - vectors[:, i], axis=1) / (values[i] / values.sum()) for i in range(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = models.principal(rows)
    assert np.allclose(scores_of(got), want) and np.allclose(scores_of(got, "b"), want)
    assert got.filter("series_id = 'a'").select(F.spark_partition_id()).distinct().count() > 1  # one series, several tasks
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clusters_of_all_points(spark, in_parts):
    x, rows = cloud(spark)
    got = scores_of(models.centre_distance(rows, clusters=3, rounds=10))
    centres = np.stack([x[np.argsort(got)[:1]][0] * 0 + c for c in x[:3]])
    for _ in range(50):
        of = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[of == i].mean(axis=0) for i in range(3)])
    inertia = (np.sqrt(((x[:, None] - centres) ** 2).sum(axis=2)).min(axis=1) ** 2).sum()
    assert (got**2).sum() < 1.05 * inertia


def test_robust_covariance_of_all_points(spark, in_parts):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 2)) @ np.array([[2, 1], [0, 1]])
    x[:300] = rng.normal(30, 1, size=(300, 2))
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, idx long, v array<double>").repartition(4)
    got = scores_of(models.covariance_distance(rows))
    assert got[:300].min() > np.quantile(got[300:], 0.999)
    inner = got[300:] <= np.median(got)
    mean, cov = x[300:][inner].mean(axis=0), np.cov(x[300:][inner], rowvar=False)
    assert np.corrcoef(got[300:], np.einsum("ij,ij->i", (x[300:] - mean) @ np.linalg.inv(cov), x[300:] - mean))[0, 1] > 0.99


@pytest.mark.parametrize("extended", [False, True])
def test_isolation_forests(spark, in_parts, extended):
    x, rows = cloud(spark)
    got = scores_of(models.isolation(rows, extended=extended, trees=50))
    assert ((got > 0) & (got < 1)).all() and got[::100].mean() > got.mean() + 0.05
    assert np.allclose(got, scores_of(models.isolation(rows.repartition(3), extended=extended, trees=50)))


def test_semi_supervised_runs_learn_from_the_prefix(spark):
    """Points behind the prefix don't change the scores of those in it; unsupervised detectors refuse a prefix."""
    one, two = spike(spark), spike(spark).withColumn("value", F.when(F.col("idx") < 150, F.col("value")).otherwise(F.col("value") ** 2))
    train = spark.createDataFrame([("a", 150)], "series_id string, train_index int")
    for name, params in (("Sub_OCSVM", {"width": 8}), ("LinearForecast", {"width": 8}), ("FITS", {"width": 8}), ("DetrendedMean", {"width": 10}), ("AutoEncoder", {"width": 1, "epochs": 2})):
        a, b = (scores_of(registry.detect_semisupervised(s, name, train, **params)) for s in (one, two))
        same = slice(0, 130)
        assert np.allclose(a[same], b[same]) == (name not in ("Sub_OCSVM", "AutoEncoder")) and not np.allclose(a[160:], b[160:]), name
    with pytest.raises(ValueError, match="unsupervised"):
        registry.detect_semisupervised(one, "SR", train)
    with pytest.raises(ValueError, match="semisupervised"):
        registry.detect_unsupervised(one, "FITS")


def test_widths_from_the_period(spark):
    two = spark.createDataFrame([(name, i, float(np.sin(2 * np.pi * i / p)) + (i == 200)) for name, p in (("a", 20), ("b", 31)) for i in range(400)], "series_id string, idx long, value double")
    got = detect(two, "Sub_PCA", period_rank=1)
    for name, p in (("a", 20), ("b", 31)):
        assert np.allclose(scores_of(got, name), scores_of(detect(two.filter(F.col("series_id") == name), "Sub_PCA", width=p), name))
    with pytest.raises(ValueError, match="period"):
        detect(two, "SR", period_rank=1)


def plain_predictions(label, pred):
    """f1, pa_f1, event_f1 and r_f1 of predictions, point by point."""

    def spans(x):
        edge = np.diff(np.concatenate([[0], x, [0]]))
        return [*zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1)]

    f = lambda tp, pp, p: 2 * tp / (pp + p) if pp + p else 0.0
    truth, found, adjusted = spans(label), spans(pred), pred.copy()
    for s, e in truth:
        if pred[s : e + 1].any():
            adjusted[max(s, 1) : e + 1] = 1
    hits = sum(pred[s : (e if e == len(label) - 1 else e + 1)].any() for s, e in truth)
    precision, recall = (label * pred).sum() / max(pred.sum(), 1), hits / len(truth)
    side = lambda a, b, mask: [mask[s : e + 1].mean() / max(sum(u <= e and s <= v for u, v in b), 1) for s, e in a]
    r = np.mean([0.2 * pred[s : e + 1].any() + 0.8 * x for (s, e), x in zip(truth, side(truth, found, pred))])
    p = np.mean(side(found, truth, label)) if found else 0.0
    return f((label * pred).sum(), pred.sum(), label.sum()), f((label * adjusted).sum(), adjusted.sum(), label.sum()), 2 * recall * precision / (recall + precision + 1e-15), 2 * r * p / (r + p) if r + p else 0.0


@pytest.mark.parametrize("seed", range(4))
def test_measures_of_predictions(spark, seed, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 16)
    monkeypatch.setattr(segments, "MEET", 16)
    rng = np.random.default_rng(seed)
    label, pred = np.zeros(90, int), (rng.random(90) < 0.3).astype(int)
    for s, e in ((0, 3), (12, 20), (31, 50), (86, 89)):
        label[s : e + 1] = 1
    pred[rng.integers(0, 60) :][:20] = 1
    p = points(spark, label).withColumn("pred", F.element_at(F.array(*[F.lit(int(x)) for x in pred]), (F.col("idx") + 1).cast("int")))
    got = measures.evaluate_predictions(p, 6).first()
    assert (got.f1, got.pa_f1, got.event_f1, got.r_f1) == pytest.approx(plain_predictions(label, pred))
    assert 0 <= got.vus_recall <= 1 and 0 <= got.vus_precision <= 1 and got.affiliation_f == pytest.approx(measures.affiliation_of_predictions(p).first().f)


@pytest.mark.parametrize("bias", ["front", "back", "middle"])
def test_biased_weights(spark, bias):
    how = {"front": lambda i, n: n - i + 1, "back": lambda i, n: i, "middle": lambda i, n: i if i <= n / 2 else n - i + 1}[bias]
    rows = spark.createDataFrame([(s, e, max(s, 5), min(e, 14)) for s in range(0, 15, 3) for e in range(max(s, 5), 25, 4)], "s long, e long, lo long, hi long")
    for r in rows.withColumn("w", measures._weight(F.col("lo"), F.col("hi"), F.col("s"), F.col("e"), bias)).collect():
        assert r.w == sum(how(i, r.e - r.s + 1) for i in range(r.lo, r.hi + 1))


def test_runs_over_bucket_borders(spark, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 7)
    label = (np.random.default_rng(8).random(120) < 0.7).astype(int)
    p = points(spark, label)
    edge = np.diff(np.concatenate([[0], label, [0]]))
    want = [*zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())]
    assert [(r.s, r.e) for r in segments.runs(p).orderBy("seg_id").collect()] == want
    assert [(r.idx, r.s <= r.idx <= r.e) for r in segments.in_runs(p).orderBy("idx").collect()] == [(i, True) for i in np.flatnonzero(label).tolist()]
    passed = p.withColumn("passed", (F.col("label") * (1 + F.col("idx") % 3)).cast("int"))
    level = label * (1 + np.arange(120) % 3)
    got = {(r.k, r.s, r.e) for r in segments.runs_over(passed).collect()}
    for k in range(3):
        edge = np.diff(np.concatenate([[0], (level > k).astype(int), [0]]))
        assert {(s, e) for x, s, e in got if x == k} == {*zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())}
    wins = {r.idx: r.window for r in frames.windows(p.withColumn("value", F.col("idx").cast("double")), 10).collect()}
    assert wins == {i: [float(j) for j in range(i, i + 10)] for i in range(111)}


@pytest.mark.parametrize("apart, past", [(0, False), (5, False), (5, True)])
def test_neighbours_in_blocks(spark, monkeypatch, apart, past):
    monkeypatch.setattr(detectors, "BLOCK", 40)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.integers(0, 3, size=(100, 4)).astype(float), rng.normal(size=(60, 4))])
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, idx long, v array<double>")
    got = {}
    for r in detectors.neighbours(rows, 4, apart, past).orderBy("idx", "rank").collect():
        got.setdefault(r.idx, []).append((r.other, pytest.approx(r.dist)))
    for i in range(160):
        others = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(160) if abs(i - j) > apart and i != j and (j < i or not past))[:4]
        assert [(j, d**0.5) for d, j in others] == got.get(i, [])


def test_confidence(spark):
    from math import comb

    x = np.random.default_rng(3).normal(size=40).round(1)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx long, score double")
    for r in features.confidence(rows, 0.1).collect():
        p = (1 + (x <= r.score).sum()) / 42
        tail = 1 - sum(comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(40 - 4 + 1))
        assert r.confidence == pytest.approx(tail if r.score > np.percentile(x, 90) else 1 - tail)


def test_times_and_failures_of_a_sweep(spark, tmp_path):
    both = spike(spark).unionByName(spark.createDataFrame([("b", 0, 1.0)], "series_id string, idx long, value double"))
    log = {r.detector: r for r in bench.timed_scores(both, [("SR", {}), ("Sub_PCA", {"width": 20})], str(tmp_path / "scores")).collect()}
    assert log["SR"].points == 301 and log["Sub_PCA"].failed == 1 and all(r.seconds > 0 and r.series == 2 for r in log.values())


def test_kernels():
    x = np.array([0.0, 1, 2, 3])
    assert kernels.hurst(np.random.default_rng(0).normal(size=2000)) == pytest.approx(0.55, abs=0.12)
    assert kernels.ar_coefficient(np.cumprod(np.full(50, 0.9))) == pytest.approx(0.9)


def test_sequence_distances_are_those_of_plain_recursion(spark):
    from functools import cache

    rng = np.random.default_rng(6)
    rows = [(rng.integers(0, 4, n).astype(float).tolist(), rng.integers(0, 4, m).astype(float).tolist()) for n, m in ((4, 6), (6, 6), (5, 3), (1, 4))]
    pairs = spark.createDataFrame(rows, "a array<double>, b array<double>")

    def plain(x, y, method):
        px, py = [0.0, *x], [0.0, *y]

        @cache
        def d(i, j):
            if i == 0 or j == 0:
                return (0 if i == j else np.inf) if method != "edr" else max(i, j)
            if method == "dtw":
                return abs(x[i - 1] - y[j - 1]) + min(d(i - 1, j), d(i, j - 1), d(i - 1, j - 1))
            if method == "edr":
                return min(d(i - 1, j - 1) + (abs(x[i - 1] - y[j - 1]) > 0.1), d(i - 1, j) + 1, d(i, j - 1) + 1)
            gap = 0.1 + 0.001
            return min(d(i - 1, j) + abs(px[i] - px[i - 1]) + gap, d(i, j - 1) + abs(py[j] - py[j - 1]) + gap, d(i - 1, j - 1) + abs(px[i] - py[j]) + abs(px[i - 1] - py[j - 1]) + 0.002 * abs(i - j))

        out = d(len(x), len(y))
        return out / max(len(x), len(y)) if method == "edr" else out

    for method in ("dtw", "edr", "twed"):
        for r in features.sequence_distance(pairs, method).collect():
            assert r.distance == pytest.approx(plain(r.a, r.b, method))
    same = spark.createDataFrame([([0.0, 1.0, 2.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 2.0, 4.0, 2.0])], "a array<double>, b array<double>")
    assert features.sequence_distance(same, "sbd").first().distance == pytest.approx(0, abs=0.05)


def test_rank_statistics():
    assert bench.chi_square_tail(3.841, 1) == pytest.approx(0.05, abs=1e-3)
    assert bench.chi_square_tail(30.0, 4) == pytest.approx(4.9e-6, rel=0.01)
    assert bench.studentised_tail(3.314, 3) == pytest.approx(0.05, abs=1e-3)
    assert bench.cliques(["a", "b", "c"], {("a", "c")}) == [("a", "b"), ("b", "c")]


def test_csv_series(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Data,Label\n1.5,0\n,1\n2.5,1\n")
    rows = sources.csv_series(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.series_id, r.idx, r.value, r.label) for r in rows] == [("x.csv", 0, 1.5, 0), ("x.csv", 1, 2.5, 1)]



def run_stream(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_windows_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    live = run_stream(streams.tumbling(streams.stream(spark, str(tmp_path / "in"), events.schema)), "tumbling", "complete")
    assert live.exceptAll(streams.tumbling(events)).count() == 0 and live.count() == streams.tumbling(events).count()


def test_stateful_detectors_run_over_batches(spark, tmp_path):
    rows = spike(spark)
    for i in range(3):
        rows.filter(F.col("idx").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, step in enumerate((streams.ema_residual, lambda x: streams.left_profile(x, 20))):
        assert run_stream(step(source()), f"state{i}").count() == 300
