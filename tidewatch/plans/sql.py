"""The library from SQL: series and scores as views, table functions over ordered rows, measures as aggregates.

``publish`` makes of a table of series the view ``series`` and, for each detector, ``scores_<name>`` (series_id, idx,
score, label) and ``measures_<name>`` (series_id, auc_roc, auc_pr and f1), which are worked out when they are read, by as many
tasks as the API's.  The table functions read the rows of a series in order, one by one, and keep a few numbers; the
aggregates (``auc_roc``, ``auc_pr``) take the scores and labels of a group, which must fit into a task: use the views
for long series.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.measures import average_precision, best_f1, roc_auc
from tidewatch.plans.registry import detect


class Segments:
    """Runs of rows whose label (or prediction) is over 0, of rows (series_id, idx, label) ordered by idx."""

    def __init__(self) -> None:
        self.run: list | None = None
        self.number = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        series, idx, label = row[0], row[1], row[2]
        if label is None or label <= 0:
            return
        if self.run is not None and self.run[2] + 1 == idx:
            self.run[2] = idx
            return
        yield from self.terminate()
        self.run = [series, idx, idx]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            self.number += 1
            yield self.run[0], self.number, self.run[1], self.run[2]
        self.run = None


class Thresholds:
    """So many thresholds in equal steps from the least to the greatest score, of rows (series_id, score)."""

    def __init__(self) -> None:
        self.series: str | None = None
        self.ends: tuple[float, float] | None = None
        self.steps = 0

    def eval(self, row: Row, steps: int) -> None:
        self.series, self.steps = row[0], steps
        if row[1] is not None:
            lo, hi = self.ends or (row[1], row[1])
            self.ends = min(lo, row[1]), max(hi, row[1])

    def terminate(self) -> Iterator[tuple]:
        if self.ends is not None:
            lo, hi = self.ends
            for k in range(self.steps):
                yield self.series, k, float(lo + (hi - lo) * k / max(self.steps - 1, 1))


def _curve(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points and positives of each distinct score, and at or above it, from the greatest down."""
    values, at = np.unique(-score, return_inverse=True)
    own, hit = np.bincount(at, minlength=len(values)), np.bincount(at, label, len(values))
    return own, hit, own.cumsum(), hit.cumsum()


def auc_roc_of(score: pd.Series, label: pd.Series) -> float:
    own, hit, n, p = _curve(score.to_numpy(float), label.to_numpy(float))
    if not len(n) or not 0 < p[-1] < n[-1]:
        return None
    return float(((own - hit) * (p - hit / 2)).sum() / (p[-1] * (n[-1] - p[-1])))


def auc_pr_of(score: pd.Series, label: pd.Series) -> float:
    _, hit, n, p = _curve(score.to_numpy(float), label.to_numpy(float))
    return float((hit / p[-1] * p / n).sum()) if len(p) and p[-1] else None


def register_functions(spark: SparkSession) -> None:
    """anomaly_segments and score_thresholds as table functions, auc_roc and auc_pr as aggregates."""
    spark.udtf.register("anomaly_segments", F.udtf(Segments, returnType="series_id string, seg_id int, s long, e long"))
    spark.udtf.register("score_thresholds", F.udtf(Thresholds, returnType="series_id string, k int, theta double"))
    for name, how in (("auc_roc", auc_roc_of), ("auc_pr", auc_pr_of)):
        # The kind is told by the type hints, which must be types and not texts.
        how.__annotations__ = {"score": pd.Series, "label": pd.Series, "return": float}
        spark.udf.register(name, F.pandas_udf(how, "double"))


def publish(spark: SparkSession, series: DataFrame, detectors: Mapping[str, Mapping[str, Any]]) -> None:
    """The views of a table of series with labels, and of the detectors (name to parameters); the functions too."""
    register_functions(spark)
    series.createOrReplaceTempView("series")
    for name, params in detectors.items():
        scored = detect(series, name, **params).select("series_id", "idx", "score").join(series.select("series_id", "idx", "label"), ["series_id", "idx"])
        scored.createOrReplaceTempView(f"scores_{name.lower()}")
        measured = roc_auc(scored).join(average_precision(scored), "series_id", "left").join(best_f1(scored), "series_id", "left")
        measured.createOrReplaceTempView(f"measures_{name.lower()}")
