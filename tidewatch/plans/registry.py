"""Detectors by name, run over many series at once; parameters, training prefixes, widths from the period, and what users register.

A column ``train`` (boolean) of a series marks the points that a semi-supervised detector is fitted on; without it such
a detector takes the first TRAIN of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import detectors as d
from tidewatch.operators import kernels as k
from tidewatch.operators import models as m
from tidewatch.operators.frames import edge_pad, left_hold_pad, reverse_windowing, windows, zscore_rows
from tidewatch.operators.period import period
from tidewatch.sources.lineage import materialise
from tidewatch.streaming.online import adapted_scores

Scores = Callable[..., DataFrame]
#: The part of a series that semi-supervised detectors are fitted on where no points are marked.
TRAIN = 0.3


@dataclass(frozen=True)
class Detector:
    """``run(series, **params)`` gives scores (series_id, idx, score)."""

    name: str
    run: Scores | None
    params: Mapping[str, Any] = field(default_factory=dict)
    semi: bool = False
    channels: bool = False  # takes features instead of value
    why_not: str = ""


REGISTRY: dict[str, Detector] = {}


def register(name: str, run: Scores | None = None, *, semi: bool = False, channels: bool = False, why_not: str = "", **params: Any) -> None:
    REGISTRY[name] = Detector(name, run, params, semi, channels, why_not)


def per_series(kernel: Callable[..., np.ndarray], semi: bool = False) -> Scores:
    """A detector from a helper that scores the array of one series, which has to fit in a task; an error of a series becomes its ``error``, not the job's.

    With ``semi`` the helper also gets ``limit``, the number of points of the training part.
    """

    def run(series: DataFrame, **params: Any) -> DataFrame:
        column = "features" if "features" in series.columns else "value"
        marked = "train" in series.columns

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            x = np.stack(pdf[column].to_list()) if column == "features" else pdf[column].to_numpy(float)
            limit = {"limit": int(pdf["train"].sum()) if marked else max(int(TRAIN * len(pdf)), 2)} if semi else {}
            try:
                out, error = kernel(x, **limit, **params), None
            except (ValueError, np.linalg.LinAlgError, IndexError, ZeroDivisionError) as e:
                out, error = np.full(len(pdf), np.nan), str(e)
            return pd.DataFrame({"series_id": pdf["series_id"], "idx": pdf["idx"], "score": out, "error": error})

        return series.select("series_id", "idx", column, *(["train"] if marked else [])).groupBy("series_id").applyInPandas(score, "series_id string, idx long, score double, error string")

    return run


def training(points: DataFrame, series: DataFrame, width: int) -> DataFrame:
    """The points (windows of ``width``) that lie in the training part of their series."""
    if "train" in series.columns:
        limits = series.filter("train").groupBy("series_id").agg((F.max("idx") + 1).alias("_limit"))
    else:
        limits = series.groupBy("series_id").agg(F.greatest(F.floor(F.count("*") * TRAIN), F.lit(2)).alias("_limit"))
    return points.join(limits, "series_id").filter(F.col("idx") + width <= F.greatest("_limit", F.lit(width + 1))).drop("_limit")


@dataclass(frozen=True)
class Modelled:
    """A detector whose models can be kept: the points it makes of a series, the kind of model, and the way back from scores of windows to scores of points.

    A series without a window has null scores and an error.
    """

    kind: m.Kind
    points: Callable[[DataFrame, int], DataFrame]
    back: Callable[[DataFrame, DataFrame, int], DataFrame]
    reach: int = 0  # values behind a window that it looks at
    fixed: Mapping[str, Any] = field(default_factory=dict)

    def width(self, series: DataFrame, width: int) -> int:
        return 1 if "features" in series.columns else width

    def fit(self, series: DataFrame, semi: bool, width: int = 1, **params: Any) -> DataFrame:
        """series_id and model; of the training part only, if ``semi``."""
        points = self.points(series, width)
        return self.kind.fit(training(points, series, self.width(series, width) + self.reach) if semi else points, **self.fixed, **params)

    def score(self, series: DataFrame, models: DataFrame, width: int = 1, **params: Any) -> DataFrame:
        found = self.kind.score(self.points(series, width), models, **self.fixed, **params)
        padded = found if "features" in series.columns else self.back(found, series, width)
        error = F.when(F.col("score").isNull(), F.lit(f"no window of {width} points"))
        return series.select("series_id", "idx").join(padded, ["series_id", "idx"], "left").select("series_id", "idx", "score", error.alias("error"))


#: Detectors whose models can be kept, by name.
MODELLED: dict[str, Modelled] = {}


def register_model(name: str, kind: m.Kind, points: Callable[[DataFrame, int], DataFrame], back: Callable[..., DataFrame] = edge_pad, *, semi: bool = False, channels: bool = False, reach: int = 0, fixed: Mapping[str, Any] | None = None, **params: Any) -> None:
    """Register a detector that fits a model of points and then scores them."""
    entry = MODELLED[name] = Modelled(kind, points, back, reach, fixed or {})

    def run(series: DataFrame, **given: Any) -> DataFrame:
        return entry.score(series, entry.fit(series, semi, **given), **given)

    register(name, run, semi=semi, channels=channels, **params)


def _rows_or_windows(series: DataFrame, width: int) -> DataFrame:
    """Rows of channels, or else normalised windows of one channel."""
    return d.channel_points(series) if "features" in series.columns else d.window_points(series, width)


def normalised_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Windows of one channel, each lag normalised; points of several channels, each normalised by itself."""
    if v.ndim == 1:
        w = np.lib.stride_tricks.sliding_window_view(v, min(width, len(v)))
        std = w.std(axis=0)
        return np.where(std > 0, (w - w.mean(axis=0)) / np.where(std > 0, std, 1), 0)
    std = v.std(axis=1, ddof=1, keepdims=True)
    return np.where(std > 0, (v - v.mean(axis=1, keepdims=True)) / np.where(std > 0, std, 1), 0)


def padded(scores: np.ndarray, n: int) -> np.ndarray:
    """Window scores to n points: each at the middle of its window."""
    width = n - len(scores) + 1
    before = -(-(width - 1) // 2)
    return np.pad(scores, (before, n - len(scores) - before), "edge")


def forecaster(predict: Callable[[np.ndarray], np.ndarray]) -> Scores:
    """A detector from a function from windows (rows) to the next values: squared errors, 0 until the first forecast."""

    def kernel(v: np.ndarray, width: int = 50) -> np.ndarray:
        channels = v[:, None] if v.ndim == 1 else v
        errors = np.zeros(len(v))
        for c in channels.T:
            w = np.lib.stride_tricks.sliding_window_view(c, width + 1)
            errors[width:] += (predict(w[:, :-1]) - w[:, -1]) ** 2 / channels.shape[1]
        return errors

    return per_series(kernel)


def _windowed(series: DataFrame, width: int) -> DataFrame:
    return windows(series, width).select("series_id", "idx", F.col("window").alias("v"))


def _next_value(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[:, :-1], v[:, -1:]


def low_frequencies(every: int = 4) -> m.Kind:
    """A window's last value, rebuilt linearly from the low frequencies of every ``every``-th value."""

    def sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (v - v.mean(axis=1, keepdims=True)) / np.maximum(v.std(axis=1, keepdims=True), 1e-8)
        low = np.fft.rfft(z[:, ::every])
        return np.hstack([low.real, low.imag]), z

    return m.linear_kind(sides, last=True, scale=lambda v: np.maximum(v.std(axis=1), 1e-8))


def _frequency_models(points: DataFrame, every: int = 4, **params: Any) -> DataFrame:
    return low_frequencies(every).fit(points, **params)


def _frequency_errors(model: Any, v: np.ndarray, every: int = 4) -> np.ndarray:
    return low_frequencies(every).how(model, v)


def seasonal(series: DataFrame, width: int = 24) -> DataFrame:
    """Squared differences from the value one season (``width``) before; 0 in the first season."""
    before = series.select("series_id", (F.col("idx") + width).alias("idx"), F.col("value").alias("_before"))
    return series.join(before, ["series_id", "idx"], "left").select("series_id", "idx", F.coalesce(F.pow(F.col("value") - F.col("_before"), 2), F.lit(0.0)).alias("score"))


def _one_class(v: np.ndarray, limit: int, width: int = 1, kernel: str = "rbf", nu: float = 0.5) -> np.ndarray:
    x = normalised_windows(v, width)
    return padded(k.one_class(x, np.arange(min(max(limit - (len(v) - len(x)), 2), len(x))), nu, kernel), len(v))


def _reconstruct(v: np.ndarray, limit: int, width: int = 50, hidden: tuple[int, ...] = (16, 4, 16), epochs: int = 30) -> np.ndarray:
    w = normalised_windows(v, width)
    return padded(k.autoencoder(w, hidden, epochs, 0, 1e-3, w[: max(limit - (len(v) - len(w)), 2)]), len(v))


def _detrended(v: np.ndarray, limit: int, width: int = 12, gamma: float = 0.99, quantile: float = 0.9) -> np.ndarray:
    """Mean squares of windows less their slowly moving mean, which only follows windows scored normal."""
    w = np.lib.stride_tricks.sliding_window_view(v, width)[::width]
    mean = w[: max(2, limit // width)].mean()
    edge = np.quantile(((w[: max(2, limit // width)] - mean) ** 2).mean(axis=1), quantile)
    scores = np.zeros(len(w))
    for i, x in enumerate(w):
        scores[i] = ((x - mean) ** 2).mean()
        if scores[i] < edge:
            mean += (1 - gamma) * (x.mean() - mean)
    out = np.repeat(scores, width)
    return np.pad(out, (0, len(v) - len(out)), "edge")


def _online_shapes(v: np.ndarray, width: int = 24, **params: Any) -> np.ndarray:
    """k-shape clusters batch by batch, after the first TRAIN of the points."""
    return k.shape_scores(v, width, start=max(int(TRAIN * len(v)), 2), batch=max(5 * width, int(0.1 * len(v))), **params)


def _scaled_windows(series: DataFrame, width: int) -> DataFrame:
    return zscore_rows(windows(series, width)).select("series_id", "idx", F.col("window").alias("v"))


def _sub(points: Callable[..., DataFrame]) -> Scores:
    """A detector on windows from one on points."""
    return lambda series, width=50, **p: edge_pad(points(d.window_points(series, width), **p), series, width)


NOT_SHIPPED = "its source is not published"
NO_WEIGHTS = "its pretrained weights are not here; give a forecast with `forecaster`"
NO_NETWORK = "needs a deep-learning library; give a network with `forecaster` or `per_series`"
register("FFT", d.fft_regions, keep=5, neighbourhood=21, limit=0.6)
register_model("IForest", m.isolation, _rows_or_windows, width=100, trees=100, columns=1, sample=256, seed=0, pool=m.POOL)
register_model("Sub_IForest", m.isolation, _rows_or_windows, width=50, trees=100, columns=1, sample=256, seed=0, pool=m.POOL)
register("LOF", lambda s, **p: d.lof(d.channel_points(s), **p), channels=True, k=30, metric="euclidean")
register("Sub_LOF", _sub(d.lof), width=50, k=30, metric="euclidean")
register("POLY", lambda s, width, power: d.poly_blocks(s, width, power=power), width=100, power=3)
register("MatrixProfile", d.matrix_profile, width=24)
register("Left_STAMPi", d.left_profile, width=24, warm_up=50)
register("SAND", per_series(_online_shapes), width=24, k=6)
register("KShapeAD", per_series(k.shape_scores), width=24, k=6)
register("Series2Graph", why_not=NOT_SHIPPED)
register("NORMA", why_not=NOT_SHIPPED)
register_model("Sub_PCA", m.principal, _rows_or_windows, width=50, keep=None)
register_model("PCA", m.principal, _rows_or_windows, width=100, keep=None)
register("HBOS", lambda s, **p: d.hbos(d.channel_values(zscore_rows(s, "features")), **p), channels=True, bins=10, tol=0.5)
register("Sub_HBOS", d.sub_hbos, width=50, bins=10, tol=0.5)
register("OCSVM", per_series(_one_class, semi=True), channels=True, semi=True, width=1, kernel="rbf", nu=0.5)
register("Sub_OCSVM", per_series(_one_class, semi=True), semi=True, width=50, kernel="rbf", nu=0.5)
register_model("MCD", m.covariance_distance, _rows_or_windows, channels=True, semi=True, support=None, seed=0, pool=m.POOL)
register_model("Sub_MCD", m.covariance_distance, _rows_or_windows, semi=True, width=10, support=None, seed=0, pool=m.POOL)
register("KNN", lambda s, **p: d.knn(d.channel_points(s), **p), channels=True, k=10, method="largest", metric="euclidean")
register("Sub_KNN", _sub(d.knn), width=50, k=10, method="largest", metric="euclidean")
register_model("KMeansAD_U", m.centre_distance, _scaled_windows, reverse_windowing, width=50, clusters=20, seed=2024, pool=m.POOL)
register_model("KMeansAD", m.centre_distance, _scaled_windows, reverse_windowing, width=50, clusters=10, seed=2024, pool=m.POOL)
register("COPOD", lambda s: d.copod(d.channel_values(zscore_rows(s, "features"))), channels=True)
register_model("CBLOF", m.cluster_factor, _rows_or_windows, channels=True, clusters=8, alpha=0.9, beta=5.0, weighted=False, seed=2024, pool=m.POOL)
register("COF", lambda s, **p: d.cof(d.channel_points(s), **p), channels=True, k=10)
register_model("EIF", m.isolation, _rows_or_windows, channels=True, fixed={"extended": True}, trees=100, sample=256, seed=0, pool=m.POOL)
register("RobustPCA", per_series(k.robust_principal), channels=True, rounds=1000)
register("SR", per_series(k.spectral_residual))
register("AutoEncoder", per_series(_reconstruct, semi=True), semi=True, width=50, hidden=(16, 4, 16), epochs=30)
register_model("FITS", m.Kind(_frequency_models, _frequency_errors, ("every",)), _windowed, semi=True, width=50, every=4, ridge=1e-2)
for _name in ("CNN", "LSTMAD", "TranAD", "OmniAnomaly", "AnomalyTransformer", "TimesNet", "Donut", "OFA", "USAD"):
    register(_name, semi=True, why_not=NO_NETWORK)
for _name in ("Chronos", "TimesFM", "Lag_Llama", "MOMENT_ZS", "MOMENT_FT"):
    register(_name, semi=_name.endswith("FT"), why_not=NO_WEIGHTS)
register("M2N2", per_series(adapted_scores, semi=True), semi=True, width=12, latent=8, epochs=30, rate=0.05, online_rate=0.01, gamma=0.99, quantile=0.95, seed=0)
#: Small detectors of the same kinds, under names of their own.
register("Seasonal", seasonal, width=24)
register_model("LinearForecast", m.linear_kind(_next_value), lambda s, width: _windowed(s, width + 1), left_hold_pad, semi=True, reach=1, width=50, ridge=1e-2)
register("DetrendedMean", per_series(_detrended, semi=True), semi=True, width=12)


def detect(series: DataFrame, name: str, period_rank: int | None = None, **params: Any) -> DataFrame:
    """series_id, detector, idx, score and error of one detector; unknown names and parameters raise ValueError.

    ``period_rank``: the width of each series is its period of that rank (1 to 3).  Series of the same period go
    together, so there is a plan for each of the periods that occur, which are at most 300.
    """
    if (entry := REGISTRY.get(name)) is None:
        raise ValueError(f"no detector {name!r}")
    if entry.run is None:
        raise ValueError(f"{name} is not available: {entry.why_not}")
    if unknown := set(params) - set(entry.params):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    if not entry.semi:
        series = series.drop("train")
    if period_rank is not None:
        if "width" not in entry.params or "width" in params:
            raise ValueError(f"the width of {name} can't come from the period")
        lengths = materialise(period(series, period_rank))
        found = [r["period"] for r in lengths.select("period").distinct().orderBy("period").collect()]
        parts = [detect(series.join(lengths.filter(F.col("period") == w).select("series_id"), "series_id", "left_semi"), name, width=w, **params) for w in found]
        return reduce(DataFrame.unionByName, parts) if parts else detect(series, name, **params)
    out = entry.run(series, **{**entry.params, **params})
    error = F.col("error") if "error" in out.columns else F.lit(None).cast("string")
    return out.select("series_id", F.lit(name).alias("detector"), "idx", "score", error.alias("error"))


def detect_unsupervised(series: DataFrame, name: str, **params: Any) -> DataFrame:
    """Fit and score whole series."""
    if name in REGISTRY and REGISTRY[name].semi:
        raise ValueError(f"{name} is fitted on a training part: detect_semisupervised")
    return detect(series, name, **params)


def detect_semisupervised(series: DataFrame, name: str, train: DataFrame, **params: Any) -> DataFrame:
    """Fit on the first train_index points of each series (rows series_id, train_index) and score all."""
    if name in REGISTRY and not REGISTRY[name].semi:
        raise ValueError(f"{name} is not fitted on a training part: detect_unsupervised")
    marked = series.join(train.select("series_id", "train_index"), "series_id").withColumn("train", F.col("idx") < F.col("train_index")).drop("train_index")
    return detect(marked, name, **params)
