"""Additive decomposition of series into trend, season and residual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.segments import bucket


def moving_means(series: DataFrame, period: int) -> DataFrame:
    """series_id, idx, value and trend: the mean of a period around each point (for an even period the two outermost points count half); null where it doesn't fit."""
    half = period // 2
    dealt = series.select("series_id", "idx", "value", F.explode(F.sequence(F.greatest(bucket(F.col("idx") - half), F.lit(0)), bucket(F.col("idx") + half))).alias("_bucket"))
    frame = Window.partitionBy("series_id", "_bucket").orderBy("idx")
    around = frame.rowsBetween(-half, half)
    inner = frame.rowsBetween(1 - half, half - 1) if period % 2 == 0 else around
    total = F.sum("value").over(inner)
    if period % 2 == 0:
        total = total + (F.lag("value", half).over(frame) + F.lead("value", half).over(frame)) / 2
    whole = F.when(F.count("*").over(around) == 2 * half + 1, total / period)
    return dealt.withColumn("trend", whole).filter(F.col("_bucket") == bucket()).drop("_bucket")


def decompose(series: DataFrame, period: int, extrapolate: bool = True) -> DataFrame:
    """series_id, idx, value, trend, seasonal and residual.

    The season is the mean of what is left over at each place of the period, less their mean.  With ``extrapolate``
    the trend goes on at both ends along lines through the nearest ``period`` points of it, and all points have a
    residual.  Series of less than two periods have no trend, and nulls.
    """
    means = moving_means(series, period)
    sizes = means.filter("trend IS NOT NULL").groupBy("series_id").agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"), F.count("*").alias("_n"))
    sizes = sizes.filter(F.col("_n") > period)
    rows = means.join(sizes, "series_id", "left").withColumn("trend", F.when(F.col("_n").isNotNull(), F.col("trend")))
    if extrapolate:
        near = {"a": F.col("idx") < F.col("_lo") + period, "b": F.col("idx") > F.col("_hi") - period}
        lines = [f(F.when(side & F.col("trend").isNotNull(), F.col("trend")), F.when(side & F.col("trend").isNotNull(), F.col("idx"))).alias(f"_{name}_{end}") for end, side in near.items() for name, f in (("slope", F.regr_slope), ("at", F.regr_intercept))]
        rows = rows.join(rows.groupBy("series_id").agg(*lines), "series_id")
        line = lambda end: F.col(f"_at_{end}") + F.col(f"_slope_{end}") * F.col("idx")
        rows = rows.withColumn("trend", F.when(F.col("idx") < F.col("_lo"), line("a")).when(F.col("idx") > F.col("_hi"), line("b")).otherwise(F.col("trend")))
    rows = rows.select("series_id", "idx", "value", "trend", F.pmod("idx", F.lit(period)).alias("_phase"))
    phases = rows.groupBy("series_id", "_phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_mean"))  # as many as places of the period
    phases = phases.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(Window.partitionBy("series_id"))).drop("_mean")
    return rows.join(phases, ["series_id", "_phase"]).select("series_id", "idx", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))
