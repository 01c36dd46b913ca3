"""Features of windows and columns, probabilities and ranks of scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import arrays
from tidewatch.operators import kernels
from tidewatch.operators.distances import BATCH, batched
from tidewatch.operators.frames import mean_of, std_of, windows
from tidewatch.operators.ranks import at_or_below


def window_features(series: DataFrame, width: int, lag: int = 1) -> DataFrame:
    """Mean, variance, skew, kurtosis, extremes and autocorrelation of each window."""
    w = F.col("window")
    return windows(series, width).select("series_id", "idx", mean_of(w).alias("mean"), F.pow(std_of(w, 0), 2).alias("variance"), arrays.skewness(w).alias("skew"), arrays.kurtosis(w).alias("kurtosis"), F.array_max(w).alias("greatest"), F.array_min(w).alias("least"), arrays.autocorrelation(w, lag).alias("autocorrelation"))


def ecdf(values: DataFrame) -> DataFrame:
    """Share of a column's values at or below each (rows series_id, idx, lag, value)."""
    shares = at_or_below(values, ["series_id", "lag"], "value").select("series_id", "lag", "value", (F.col("below") / F.col("n")).alias("ecdf"))
    return values.select("series_id", "idx", "lag", "value").join(shares, ["series_id", "lag", "value"]).select("series_id", "idx", "lag", "ecdf")


def column_entropy(values: DataFrame, bins: int = 10) -> DataFrame:
    """Entropy of each column's histogram, and weight: 1 less the entropy over that of equal bins."""
    ends = values.groupBy("series_id", "lag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    counts = values.join(ends, ["series_id", "lag"]).groupBy("series_id", "lag", "n", F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).alias("bin")).count()
    p = F.col("count") / F.col("n")
    return counts.groupBy("series_id", "lag").agg((-F.sum(p * F.log2(p))).alias("entropy")).withColumn("weight", 1 - F.col("entropy") / F.log2(F.lit(float(bins))))


def correlations(values: DataFrame) -> DataFrame:
    """Pearson's correlation of each pair of a series' columns."""
    a, b = values.select("series_id", "idx", F.col("lag").alias("a"), F.col("value").alias("x")), values.select("series_id", "idx", F.col("lag").alias("b"), F.col("value").alias("y"))
    return a.join(b, ["series_id", "idx"]).filter("a < b").groupBy("series_id", "a", "b").agg(F.corr("x", "y").alias("pearson"))


def weighted_correlation(rows: DataFrame) -> DataFrame:
    """Pearson's correlation of x and y with weights w, for each series_id."""
    mean = rows.groupBy("series_id").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"))
    d = rows.join(mean, "series_id").withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
    return d.groupBy("series_id").agg((F.sum(F.col("w") * F.col("dx") * F.col("dy")) / F.sqrt(F.sum(F.col("w") * F.col("dx") ** 2) * F.sum(F.col("w") * F.col("dy") ** 2))).alias("pearson"))


def probability(scored: DataFrame, method: str = "linear") -> DataFrame:
    """Add probability: scores from 0 to 1 over their series, or by the normal distribution, where under the mean counts as 0."""
    stats = scored.groupBy("series_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    rows = scored.join(stats, "series_id")
    if method == "linear":
        p = (F.col("score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    else:
        p = arrays.erf((F.col("score") - F.col("_m")) / F.nullif(F.col("_s") * 2**0.5, F.lit(0.0)))
    return rows.withColumn("probability", F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi", "_m", "_s")


def score_rank(scored: DataFrame, normalise: bool = False) -> DataFrame:
    """Add rank: how many scores of the series are at or below."""
    ranks = at_or_below(scored, ["series_id"], "score").select("series_id", "score", (F.col("below") / F.col("n") if normalise else F.col("below")).alias("rank"))
    return scored.join(ranks, ["series_id", "score"]).select(*scored.columns, "rank")


def _log_chance(k: np.ndarray, n: float, x: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of k >= 1 successes in n trials of chance x, by deviances: differences of lgamma lose nine digits at a million trials."""

    def beyond(m: np.ndarray) -> np.ndarray:
        """Logarithm of the factorial over Stirling's formula."""
        small = np.array([lgamma(v + 1) - (v + 0.5) * log(v) + v - 0.5 * log(2 * pi) for v in np.minimum(m, 16)])
        return np.where(m < 16, small, (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m**2) / m**2) / m**2) / m)

    def deviance(m: np.ndarray, mean: np.ndarray) -> np.ndarray:
        e = (m - mean) / mean
        return mean * ((1 + e) * np.log1p(e) - e)

    rest = np.maximum(n - k, 1.0)
    most = beyond(np.array([n])) - beyond(k) - beyond(rest) - deviance(k, n * x) - deviance(rest, n * (1 - x)) + 0.5 * np.log(n / (2 * pi * k * rest))
    return np.where(k < n, most, n * np.log(x))


def beta_share(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The regularised incomplete beta function at 0 < x < 1, by its continued fraction: the chance of at least a successes in a + b - 1 trials of chance x."""
    turned = x > (a + 1) / (a + b + 2)
    x, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    tiny = 1e-300
    c, d = np.ones(len(x)), 1 / np.where(np.abs(y := 1 - (p + q) * x / (p + 1)) < tiny, tiny, y)
    h = d.copy()
    # Some roots of the smaller number of steps reach this; what rounding adds stays over a smaller limit for good.
    enough = 1e-15 + 4e-16 * min(a, b) ** 0.5
    for m in range(1, 100_000):
        before = h
        for part in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + part / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if (np.abs(h - before) <= enough * np.abs(h)).all():
            break
    head = np.exp(_log_chance(p, a + b - 1, x)) * (1 - x)
    return np.clip(np.where(turned, 1 - head * h, head * h), 0, 1)


def chance_of_more(rank: np.ndarray, n: int, contamination: float) -> np.ndarray:
    """P(X > n - int(n * contamination)) for X of n trials of chance (1 + rank) / (2 + n).

    By Hoeffding's bound it is less than exp(-2 d * d / n) from 0 or 1 where it lies d from the mean; the fraction is worked out
    only where that is over exp(-40), which no sum with 1 shows.
    """
    least, x = n - int(n * contamination) + 1, (1 + rank) / (2 + n)
    if least > n:
        return np.zeros(len(rank))
    apart = least - n * x
    out = np.where(apart > 0, 0.0, 1.0)
    near = np.flatnonzero((apart - np.sign(apart)) ** 2 * 2 <= 40 * n)
    if len(near):
        out[near] = beta_share(x[near], float(least), float(n - least + 1))
    return out


def confidence(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Add confidence: how likely the prediction (a score over the percentile that leaves the contamination) would stay under other samples of the series.

    A score's posterior chance of being an outlier is (1 + its rank) / (2 + n); the confidence is a tail of the
    binomial distribution with that chance, worked out once for each distinct score.
    """
    steps = at_or_below(scored, ["series_id"], "score")
    # The percentile between two neighbours in ascending order, linear as Spark's own, from counts of distinct scores.
    at = (F.col("n") - 1) * F.lit(1 - contamination)
    value = lambda place: F.max(F.when((F.col("n") - F.col("above") <= place) & (place < F.col("below")), F.col("score")))
    ends = steps.groupBy("series_id").agg(value(F.floor(at)).alias("_a"), value(F.ceil(at)).alias("_b"), F.first(F.ceil(at) - at).alias("_to"), F.first(at - F.floor(at)).alias("_from"))
    limits = ends.select("series_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_to") * F.col("_a") + F.col("_from") * F.col("_b")).alias("_limit"))

    @F.pandas_udf("double")
    def tail(rank: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(rank))
        for size in np.unique(n):
            own = np.flatnonzero(n == size)
            out[own] = chance_of_more(rank.to_numpy(float)[own], int(size), contamination)
        return pd.Series(out)

    chances = steps.withColumn("_c", tail("below", "n")).join(limits, "series_id")
    chosen = chances.select("series_id", "score", F.when(F.col("score") > F.col("_limit"), F.col("_c")).otherwise(1 - F.col("_c")).alias("confidence"))
    return scored.join(chosen, ["series_id", "score"]).select(*scored.columns, "confidence")


def sequence_statistics(series: DataFrame, width: int, order: int = 1) -> DataFrame:
    """autoregression (the coefficient of the oldest of ``order`` values), entropy (of samples) and hurst of each window; null where undefined."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [np.asarray(x, float) for x in b["window"]]
            each = lambda f: [None if not np.isfinite(y := f(x)) else y for x in w]  # noqa: B023, E731
            yield pd.DataFrame({"series_id": b["series_id"], "idx": b["idx"], "autoregression": each(lambda x: kernels.ar_coefficient(x, order)), "entropy": each(kernels.sample_entropy), "hurst": each(kernels.hurst)})

    return windows(series, width).select("series_id", "idx", "window").mapInPandas(run, "series_id string, idx long, autoregression double, entropy double, hurst double")


def sequence_distance(pairs: DataFrame, method: str, **params: float) -> DataFrame:
    """Add distance: of the array columns a and b of each row, by dtw, edr, twed, mahalanobis (of their difference), sbd (shape) or garch; null where one is null or empty."""
    how = BATCH[method]

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return batched(how, a, b, **params)

    return pairs.withColumn("distance", distance("a", "b"))


def optimal_bins(values: DataFrame, most: int | None = None) -> DataFrame:
    """series_id, lag and bins: the number of equal bins (up to ``most``, or else the root of the number of values) with the greatest penalised likelihood."""
    ends = values.groupBy("series_id", "lag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    top = F.lit(most) if most else F.floor(F.sqrt("n"))
    tried = ends.withColumn("b", F.explode(F.sequence(F.lit(1), F.greatest(top.cast("int") - 1, F.lit(1)))))
    bins = values.join(tried, ["series_id", "lag"]).groupBy("series_id", "lag", "n", "b", F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("b")), F.col("b") - 1).alias("bin")).count()
    # A bin adds its likelihood; all bins, the empty ones too, pay the penalty.
    penalty = F.col("b") - 1 + F.pow(F.log("b"), 2.5)
    likelihood = bins.groupBy("series_id", "lag", "b").agg((F.sum(F.col("count") * F.log(F.col("b") * F.col("count") / F.col("n") + 1)) - F.col("b") * F.first(penalty)).alias("gain"))
    return likelihood.groupBy("series_id", "lag").agg(F.max_by("b", F.struct("gain", -F.col("b"))).alias("bins"))


def similarity(points: DataFrame, alpha: float) -> DataFrame:
    """series_id, idx and similarity of points (array column v) to their series' mean: 2 ** (-alpha * the mean of the squared normalised components)."""
    lags = points.select("series_id", "idx", F.posexplode("v").alias("lag", "value"))
    stats = lags.groupBy("series_id", "lag").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    figures = stats.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("lag", "m", "s"))).alias("f"))
    squares = F.zip_with("v", "f", lambda x, g: F.when(g["s"] > 0, F.pow((x - g["m"]) / F.when(g["s"] > 0, g["s"]), 2)).otherwise(F.lit(0.0)))
    return points.join(figures, "series_id").select("series_id", "idx", F.pow(F.lit(2.0), -alpha * mean_of(squares)).alias("similarity"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """The n highest scores of each series; ties to the smaller index."""
    order = Window.partitionBy("series_id").orderBy(F.desc("score"), "idx")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
