"""Sweeps of detectors over series, tuning, leaderboards and rank statistics."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.measures import evaluate
from tidewatch.plans.registry import detect
from tidewatch.sources.lineage import materialise

_PERIODS, _POWERS, _NEAR, _BINS = [1, 2, 3], [1, 2, 3, 4], [10, 20, 30, 40, 50], [5, 10, 20, 30, 40]
_SUPPORT, _KEPT, _KERNELS, _TREES = [0.2, 0.4, 0.6, 0.8, None], [0.25, 0.5, 0.75, None], ["linear", "poly", "rbf", "sigmoid"], [25, 50, 100, 150, 200]
_HIDDEN = [(64, 32, 64), (32, 16, 32), (128, 64, 128)]
#: The grids of hyper-parameters that are swept, for series of one channel.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "Sub_IForest": {"period_rank": _PERIODS, "trees": _TREES},
    "IForest": {"trees": _TREES},
    "Sub_LOF": {"period_rank": _PERIODS, "k": _NEAR},
    "LOF": {"k": _NEAR},
    "POLY": {"period_rank": _PERIODS, "power": _POWERS},
    "MatrixProfile": {"period_rank": _PERIODS},
    "SAND": {"period_rank": _PERIODS},
    "Sub_PCA": {"period_rank": _PERIODS, "keep": _KEPT},
    "Sub_HBOS": {"period_rank": _PERIODS, "bins": _BINS},
    "Sub_OCSVM": {"period_rank": _PERIODS, "kernel": _KERNELS},
    "Sub_MCD": {"period_rank": _PERIODS, "support": _SUPPORT},
    "Sub_KNN": {"period_rank": _PERIODS, "k": _NEAR},
    "KMeansAD_U": {"period_rank": _PERIODS, "clusters": [10, 20, 30, 40]},
    "KShapeAD": {"period_rank": _PERIODS},
    "AutoEncoder": {"width": [50, 100, 150], "hidden": _HIDDEN},
    "FITS": {"width": [100, 200]},
}
#: The grids for series of several channels.
CHANNEL_GRIDS: dict[str, dict[str, list[Any]]] = {
    "IForest": {"trees": _TREES, "columns": [0.2, 0.4, 0.6, 0.8, 1.0]},
    "LOF": {"k": _NEAR, "metric": ["euclidean", "manhattan"]},
    "PCA": {"keep": _KEPT},
    "HBOS": {"bins": _BINS, "tol": [0.1, 0.3, 0.5, 0.7]},
    "OCSVM": {"kernel": _KERNELS, "nu": [0.1, 0.3, 0.5, 0.7]},
    "MCD": {"support": _SUPPORT},
    "KNN": {"k": _NEAR, "method": ["largest", "mean", "median"]},
    "KMeansAD": {"clusters": [10, 20, 30, 40], "width": [10, 20, 30, 40]},
    "CBLOF": {"clusters": [4, 8, 16, 32], "alpha": [0.6, 0.7, 0.8, 0.9]},
    "EIF": {"trees": [25, 50, 100, 200]},
    "RobustPCA": {"rounds": [500, 1000, 1500]},
    "COF": {"k": _NEAR},
}
#: The parameters that were found best, for series of one channel and of several.
TUNED: dict[str, dict[str, Any]] = {
    "Sub_IForest": {"period_rank": 1, "trees": 150},
    "IForest": {"trees": 200},
    "Sub_LOF": {"period_rank": 2, "k": 30},
    "LOF": {"k": 50},
    "POLY": {"period_rank": 1, "power": 4},
    "MatrixProfile": {"period_rank": 1},
    "SAND": {"period_rank": 1},
    "SR": {},
    "Sub_PCA": {"period_rank": 1, "keep": None},
    "Sub_HBOS": {"period_rank": 1, "bins": 10},
    "Sub_OCSVM": {"period_rank": 2, "kernel": "rbf"},
    "Sub_MCD": {"period_rank": 3, "support": None},
    "Sub_KNN": {"period_rank": 2, "k": 50},
    "KMeansAD_U": {"period_rank": 2, "clusters": 10},
    "KShapeAD": {"period_rank": 1},
    "FFT": {},
    "Left_STAMPi": {},
    "AutoEncoder": {"width": 100, "hidden": (128, 64, 128)},
    "FITS": {"width": 100},
    "M2N2": {},
}
CHANNELS_TUNED: dict[str, dict[str, Any]] = {
    "IForest": {"trees": 25, "columns": 0.8},
    "LOF": {"k": 50, "metric": "euclidean"},
    "PCA": {"keep": 0.25},
    "HBOS": {"bins": 30, "tol": 0.5},
    "OCSVM": {"kernel": "rbf", "nu": 0.1},
    "MCD": {"support": 0.8},
    "KNN": {"k": 50, "method": "mean"},
    "KMeansAD": {"clusters": 10, "width": 40},
    "KShapeAD": {"k": 20, "width": 40},
    "COPOD": {},
    "CBLOF": {"clusters": 4, "alpha": 0.6},
    "EIF": {"trees": 50},
    "RobustPCA": {"rounds": 1000},
    "AutoEncoder": {"hidden": (128, 64, 128)},
    "FITS": {"width": 100},
}
MEASURES = ("auc_pr", "auc_roc", "vus_pr", "vus_roc", "f1", "pa_f1", "event_f1", "r_f1", "affiliation_f")


def combinations_of(name: str, channels: bool = False) -> list[dict[str, Any]]:
    """All combinations of a detector's grid; one empty one for a detector without a grid."""
    grid = (CHANNEL_GRIDS if channels else GRIDS).get(name, {})
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def detect_tuned(series: DataFrame, name: str) -> DataFrame:
    """Scores with the parameters that were found best for series of one channel, or of several."""
    return detect(series, name, **(CHANNELS_TUNED if "features" in series.columns else TUNED).get(name, {}))


def grid_table(spark: SparkSession, grids: Mapping[str, Mapping[str, Sequence[Any]]] = GRIDS) -> DataFrame:
    """detector and params (text to text) of every combination."""
    rows = [(name, {k: str(v) for k, v in zip(grid, values)}) for name, grid in grids.items() for values in product(*grid.values())]
    return spark.createDataFrame(rows, "detector string, params map<string,string>")


def score_all(series: DataFrame, jobs: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """Scores of several (detector, params) over all series; each job runs over all series at once."""
    parts = [detect(series, name, **params).withColumn("params", F.lit(str(sorted(params.items())))) for name, params in jobs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timed_scores(series: DataFrame, jobs: Sequence[tuple[str, Mapping[str, Any]]], path: str) -> DataFrame:
    """Score all series with each job and write the scores to ``path``; detector, params, seconds, series, points and failed series of each job.

    One job after the other, so that each has its own time; the work of a job is spread over all tasks.
    """
    spark, rows = series.sparkSession, []
    for name, params in jobs:
        began = time.perf_counter()
        detect(series, name, **params).withColumn("params", F.lit(str(sorted(params.items())))).write.mode("append").partitionBy("detector", "params").parquet(path)
        rows.append((name, str(sorted(params.items())), time.perf_counter() - began))
    log = spark.createDataFrame(rows, "detector string, params string, seconds double")
    done = spark.read.parquet(path).groupBy("detector", "params").agg(F.countDistinct("series_id").alias("series"), F.count("*").alias("points"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("series_id"))).alias("failed"))
    return log.join(done, ["detector", "params"])


def write_measures(results: DataFrame, path: str) -> None:
    """Append rows of measures (series_id, detector, params, ...) by detector."""
    results.write.mode("append").partitionBy("detector").parquet(path)


def run_benchmark(series: DataFrame, jobs: Sequence[tuple[str, Mapping[str, Any]]], width: int) -> DataFrame:
    """series_id, detector, params and all measures; null where a detector failed."""
    scores = materialise(score_all(series, jobs).join(series.select("series_id", "idx", "label"), ["series_id", "idx"]))
    # One "series" for each series, detector and parameters, so that all are evaluated in one plan.
    named = scores.withColumn("key", F.concat_ws("\t", "series_id", "detector", "params"))
    measured = evaluate(named.filter("score IS NOT NULL AND NOT isnan(score)").select(F.col("key").alias("series_id"), "idx", "score", "label"), width)
    keys = named.groupBy("series_id", "detector", "params", "key").agg(F.max("error").alias("error"))
    return keys.join(measured.withColumnRenamed("series_id", "key"), "key", "left").drop("key")


def best_params(results: DataFrame, measure: str = "vus_pr") -> DataFrame:
    """For each detector the parameters with the highest mean of a measure."""
    means = results.groupBy("detector", "params").agg(F.avg(measure).alias("mean"))
    return means.groupBy("detector").agg(F.max_by("params", F.struct("mean", "params")).alias("params"), F.max("mean").alias("mean"))


def mean_rank(column: str, *keys: str):
    """Rank from the highest, ties at their mean."""
    order = Window.partitionBy(*keys).orderBy(F.desc(column))
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def leaderboard(results: DataFrame) -> DataFrame:
    """measure, detector, mean and rank, from rows (series_id, detector, measure, value)."""
    means = results.groupBy("measure", "detector").agg(F.avg("value").alias("mean"))
    return means.withColumn("rank", mean_rank("mean", "measure"))


def quartiles(results: DataFrame) -> DataFrame:
    """What a box plot shows of each measure and detector."""
    q = lambda p: F.percentile("value", p)
    return results.groupBy("measure", "detector").agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.avg("value").alias("mean"))


def series_ranks(results: DataFrame) -> DataFrame:
    """Each detector's rank on each series."""
    return results.withColumn("rank", mean_rank("value", "measure", "series_id"))


def average_ranks(results: DataFrame) -> DataFrame:
    return series_ranks(results).groupBy("measure", "detector").agg(F.avg("rank").alias("average_rank"), F.count("*").alias("n_series"))


def friedman(results: DataFrame) -> DataFrame:
    """The Friedman statistic over detectors, corrected for ties, and its chance (p) if all were equal, for each measure."""
    r = series_ranks(results)
    sums = r.groupBy("measure", "detector").agg(F.sum("rank").alias("s"))
    size = r.groupBy("measure").agg(F.countDistinct("series_id").alias("n"), F.countDistinct("detector").alias("k"))
    ties = r.groupBy("measure", "series_id", "value").agg(F.count("*").alias("t")).groupBy("measure").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    total = sums.groupBy("measure").agg(F.sum(F.col("s") ** 2).alias("ss"))
    n, k = F.col("n"), F.col("k")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    c = 1 - F.col("ties") / (n * k * (k * k - 1))

    @F.pandas_udf("double")
    def tail(x: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi_square_tail(a, int(b) - 1) for a, b in zip(x, count)], dtype=float)

    rows = total.join(size, "measure").join(ties, "measure").select("measure", "n", "k", (raw / F.when(c > 0, c)).alias("statistic"))
    return rows.withColumn("p", tail("statistic", "k"))


def chi_square_tail(x: float, freedom: int) -> float:
    """Chance of a chi-square value over x, by the series of the incomplete gamma function."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    for i in range(1, 10_000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def studentised_tail(q: float, k: int, steps: int = 400) -> float:
    """Chance that the range of k normal values (infinite degrees of freedom) is over q."""
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    lo, hi = -8.0, 8.0
    h = (hi - lo) / steps
    total = 0.0
    for i in range(steps + 1):
        z = lo + i * h
        weight = 1 if i in (0, steps) else 4 if i % 2 else 2
        total += weight * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (cdf(z) - cdf(z - q)) ** (k - 1)
    return min(max(1 - k * total * h / 3, 0.0), 1.0)


def nemenyi(results: DataFrame) -> DataFrame:
    """For each pair of detectors the difference of average ranks, over its standard error, and its chance under equality."""
    a = average_ranks(results)
    x, y = a.select("measure", F.col("detector").alias("a"), F.col("average_rank").alias("ra"), "n_series"), a.select("measure", F.col("detector").alias("b"), F.col("average_rank").alias("rb"))
    k = a.groupBy("measure").agg(F.count("*").alias("k"))
    pairs = x.join(y, "measure").filter("a < b").join(k, "measure").withColumn("q", F.abs(F.col("ra") - F.col("rb")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n_series"))) * 2**0.5)

    @F.pandas_udf("double")
    def tail(q: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([studentised_tail(a, int(b)) for a, b in zip(q, size)])

    return pairs.select("measure", "a", "b", (F.col("ra") - F.col("rb")).alias("difference"), "q", tail("q", "k").alias("p"))


#: Nodes of a graph whose largest cliques are listed.
NODES = 64


def maximal_cliques(neighbours: Sequence[int]) -> list[int]:
    """All maximal cliques of a graph, as sets of bits: of node i the bits of its neighbours are given.

    The steps of Bron and Kerbosch: a clique grows by the nodes linked with all of it, but not by those linked with the
    one that has most of them, as a clique without them would have to hold it or another one not linked with it.
    """
    if len(neighbours) > NODES:
        raise ValueError(f"a graph of more than {NODES} nodes")
    found: list[int] = []
    bits = lambda x: [i for i in range(len(neighbours)) if x >> i & 1]
    stack = [(0, (1 << len(neighbours)) - 1, 0)]
    while stack:
        clique, open_, done = stack.pop()
        if not open_ and not done:
            found.append(clique)
            continue
        if not open_:
            continue
        pivot = max(bits(open_ | done), key=lambda i: (open_ & neighbours[i]).bit_count())
        for i in bits(open_ & ~neighbours[pivot]):
            stack.append((clique | 1 << i, open_ & neighbours[i], done & neighbours[i]))
            open_ &= ~(1 << i)
            done |= 1 << i
    return found


def cliques(names: Sequence[str], apart: set[tuple[str, str]]) -> list[tuple[str, ...]]:
    """Largest groups of two or more detectors of which no two differ, each in the order of names; NODES names at most."""
    alike = [sum(1 << j for j, b in enumerate(names) if a != b and (a, b) not in apart and (b, a) not in apart) for a in names]
    found = [tuple(n for i, n in enumerate(names) if c >> i & 1) for c in maximal_cliques(alike)]
    return sorted((c for c in found if len(c) > 1), key=lambda c: [names.index(n) for n in c])


def clique_table(pairs: DataFrame) -> DataFrame:
    """measure and clique of rows (measure, a, b, alike): the largest groups of detectors that are all alike, for each measure."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        linked = {(a, b) for a, b, alike in zip(pdf["a"], pdf["b"], pdf["alike"]) if alike}
        apart = {(a, b) for a in names for b in names if (a, b) not in linked and (b, a) not in linked}
        return pd.DataFrame([(pdf["measure"].iloc[0], list(c)) for c in cliques(names, apart)], columns=["measure", "clique"])

    return pairs.select("measure", "a", "b", "alike").groupBy("measure").applyInPandas(run, "measure string, clique array<string>")


def outcomes(predicted: DataFrame) -> DataFrame:
    """Points with outcome tp, fp, fn or tn, as a plot marks them."""
    kind = F.when((F.col("label") == 1) & (F.col("pred") == 1), "tp").when(F.col("pred") == 1, "fp").when(F.col("label") == 1, "fn").otherwise("tn")
    return predicted.withColumn("outcome", kind)
