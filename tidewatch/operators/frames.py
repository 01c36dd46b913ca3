"""Windows over series, the way back from windows to points, and normalisation."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import at_or_below
from tidewatch.operators.segments import bucket


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("idx")


def windows(series: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """series_id, idx (of the first point) and window: every run of ``width`` values; channels one after the other.

    Points are dealt to buckets of indices, with those that windows of the bucket before reach into.
    """
    dealt = series.withColumn("_bucket", F.explode(F.sequence(F.greatest(bucket(F.col("idx") - width + 1), F.lit(0)), bucket())))
    frame = Window.partitionBy("series_id", "_bucket").orderBy("idx").rowsBetween(0, width - 1)
    if "features" in series.columns:
        rows = F.collect_list("features").over(frame)
        channel = lambda c: F.transform(rows, lambda r: r[c])
        whole = F.flatten(F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), channel))
        out = dealt.select("series_id", "idx", "_bucket", F.size(rows).alias("_n"), whole.alias("window"))
    else:
        values = F.collect_list("value").over(frame)
        out = dealt.select("series_id", "idx", "_bucket", F.size(values).alias("_n"), values.alias("window"))
    return out.filter((F.col("_bucket") == bucket()) & (F.col("_n") == width) & (F.col("idx") % stride == 0)).drop("_n", "_bucket")


def forecast_pairs(series: DataFrame, width: int, horizon: int = 1) -> DataFrame:
    """series_id, idx, window and target: the ``horizon`` values that follow each window."""
    whole = windows(series, width + horizon)
    return whole.select("series_id", "idx", F.slice("window", 1, width).alias("window"), F.slice("window", width + 1, horizon).alias("target"))


def _points(scores: DataFrame, series: DataFrame) -> DataFrame:
    sizes = scores.groupBy("series_id").agg(F.count("*").alias("_m"), F.min("score").alias("_least"))
    return series.select("series_id", "idx").join(sizes, "series_id")


def _take(points: DataFrame, scores: DataFrame, place: Column, how: str = "inner") -> DataFrame:
    """Give each point the score of the window at ``place``."""
    own = scores.select("series_id", F.col("idx").alias("_place"), "score")
    return points.withColumn("_place", place).join(own, ["series_id", "_place"], how)


def edge_pad(scores: DataFrame, series: DataFrame, width: int) -> DataFrame:
    """Window scores as point scores: each at the middle of its window, the first and last also at the edges."""
    place = F.least(F.greatest(F.col("idx") - ceil((width - 1) / 2), F.lit(0)), F.col("_m") - 1)
    return _take(_points(scores, series), scores, place.cast("long")).select("series_id", "idx", "score")


def left_hold_pad(scores: DataFrame, series: DataFrame, width: int, horizon: int = 1) -> DataFrame:
    """Forecast errors as point scores: 0 until the first forecast."""
    place = F.col("idx") - (width + horizon - 1)
    return _take(_points(scores, series), scores, place, "left").select("series_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def min_fill_pad(scores: DataFrame, series: DataFrame, width: int) -> DataFrame:
    """Each window's score at its middle, the least score at the edges."""
    return _take(_points(scores, series), scores, F.col("idx") - width // 2, "left").select("series_id", "idx", F.coalesce("score", "_least").alias("score"))


def pad_by_edge(scores: DataFrame, series: DataFrame, before: int) -> DataFrame:
    """The first score ``before`` times before all, the last one until the end."""
    place = F.least(F.greatest(F.col("idx") - before, F.lit(0)), F.col("_m") - 1)
    return _take(_points(scores, series), scores, place.cast("long")).select("series_id", "idx", "score")


def reverse_windowing(scores: DataFrame, series: DataFrame, width: int) -> DataFrame:
    """Each point's mean over the scores of all windows (stride 1) that cover it."""
    all_points = series.select("series_id", "idx").join(scores.select("series_id", "idx", "score"), ["series_id", "idx"], "left")
    return all_points.select("series_id", "idx", F.avg("score").over(by_time().rowsBetween(1 - width, 0)).alias("score"))


def coverage_mean(scores: DataFrame, width: int) -> DataFrame:
    """The same for windows of any stride."""
    covered = scores.select("series_id", F.explode(F.sequence(F.col("idx"), F.col("idx") + width - 1)).alias("idx"), "score")
    return covered.groupBy("series_id", "idx").agg(F.avg("score").alias("score"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def zscore(series: DataFrame, ddof: int = 0, column: str = "value") -> DataFrame:
    """Values less their series' mean over their deviation; 0 for a constant series."""
    std = F.stddev_pop(column) if ddof == 0 else F.stddev_samp(column)
    stats = series.groupBy("series_id").agg(F.avg(column).alias("_mean"), F.coalesce(std, F.lit(0.0)).alias("_std"))
    return series.join(stats, "series_id").withColumn(column, ratio(F.col(column) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def zscore_lags(wins: DataFrame) -> DataFrame:
    """Windows as rows (series_id, idx, lag, value), each lag normalised over all windows of the series."""
    lags = wins.select("series_id", "idx", F.posexplode("window").alias("lag", "value"))
    stats = lags.groupBy("series_id", "lag").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    return lags.join(stats, ["series_id", "lag"]).select("series_id", "idx", "lag", ratio(F.col("value") - F.col("_mean"), F.col("_std")).alias("value"))


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def std_of(x: Column, ddof: int = 1) -> Column:
    mean = mean_of(x)
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (F.size(x) - ddof))


def zscore_rows(wins: DataFrame, column: str = "window", ddof: int = 1) -> DataFrame:
    """Each window (or row of channels) normalised by itself."""
    stats = wins.withColumn("_mean", mean_of(F.col(column))).withColumn("_std", std_of(F.col(column), ddof))
    return stats.withColumn(column, F.expr(f"transform({column}, v -> CASE WHEN _std = 0 THEN 0D ELSE (v - _mean) / _std END)")).drop("_mean", "_std")


def minmax(series: DataFrame, column: str = "value") -> DataFrame:
    """Values from 0 to 1 over their series."""
    stats = series.groupBy("series_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return series.join(stats, "series_id").withColumn(column, ratio(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def minmax_rows(wins: DataFrame) -> DataFrame:
    """Each window from 0 to 1 by itself."""
    return wins.withColumn("_lo", F.array_min("window")).withColumn("_hi", F.array_max("window")).withColumn("window", F.expr("transform(window, v -> CASE WHEN _hi = _lo THEN 0D ELSE (v - _lo) / (_hi - _lo) END)")).drop("_lo", "_hi")


def standardise(series: DataFrame, train: Column) -> DataFrame:
    """Channels less the mean over the deviation (both of the training rows)."""
    lags = series.select("series_id", "idx", train.alias("_train"), F.posexplode("features").alias("channel", "value"))
    stats = lags.filter("_train").groupBy("series_id", "channel").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    return lags.join(stats, ["series_id", "channel"]).select("series_id", "idx", "channel", ((F.col("value") - F.col("_mean")) / F.greatest("_std", F.lit(1e-8))).alias("value"))


def split_valid(series: DataFrame, share: float) -> DataFrame:
    """Add is_train: the first part of each series."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    return series.withColumn("is_train", F.col("idx") < F.floor((1 - share) * n))


def down_sample(wins: DataFrame, every: int) -> DataFrame:
    return wins.withColumn("window", F.filter("window", lambda v, i: i % every == 0))


def bagging(series: DataFrame, k: int, seed: int, replace: bool = False) -> DataFrame:
    """A sample of k points of each series (all of a shorter one, unless ``replace``), the same for the same seed, however the table is cut.

    Without ``replace`` these are the points whose index has the least hashes; with it k indices are drawn by hashes of
    0 to k - 1, and a point comes as often as it is drawn.
    """
    if not replace:
        hashed = series.withColumn("_hash", F.xxhash64("series_id", "idx", F.lit(seed)))
        least = at_or_below(hashed, ["series_id"], "_hash").filter(F.col("below") <= k).select("series_id", "_hash")
        return hashed.join(least, ["series_id", "_hash"]).select(series.columns)
    drawn = series.groupBy("series_id").agg(F.count("*").alias("_n")).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    drawn = drawn.select("series_id", F.pmod(F.xxhash64("series_id", "_draw", F.lit(seed)), "_n").alias("idx"))
    return drawn.join(series, ["series_id", "idx"]).select(series.columns)


def split_values(values: DataFrame, seed: int) -> DataFrame:
    """series_id, lag and split: a value between the least and the greatest of each column (rows series_id, idx, lag, value), by a hash of the column and the seed."""
    ends = values.groupBy("series_id", "lag").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    share = F.pmod(F.xxhash64("series_id", "lag", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return ends.select("series_id", "lag", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("split"))
