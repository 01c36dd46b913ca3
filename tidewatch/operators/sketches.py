"""Quantiles of scores from sketches that are kept and merged: a day's scores are read once, thresholds of any span of days are made of the days' sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a sketch holds in its top level; a rank is then off by 1.7 % of the scores or less with a chance of 99 %.
SIZE = 200


def daily(scored: DataFrame, day: Column, size: int = SIZE) -> DataFrame:
    """series_id, day, n and sketch (bytes) of the scores of each day; map tasks pass on sketches, not scores."""
    rows = scored.select("series_id", day.alias("day"), F.col("score").cast("double").alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("series_id", "day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("score", F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """series_id, n and sketch of all days given."""
    return sketches.groupBy("series_id").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def thresholds(sketches: DataFrame, contamination: float, size: int = SIZE) -> DataFrame:
    """series_id, n and theta: the score that about so large a share of the scores lies over."""
    return merged(sketches, size).select("series_id", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(1 - contamination)).alias("theta"))


def over_sketched(scored: DataFrame, sketches: DataFrame, contamination: float) -> DataFrame:
    """Add pred: scores over the threshold of the sketches, which may be those of other days."""
    limits = thresholds(sketches, contamination).select("series_id", F.col("theta").alias("_limit"))
    return scored.join(limits, "series_id").withColumn("pred", (F.col("score") > F.col("_limit")).cast("int")).drop("_limit")
