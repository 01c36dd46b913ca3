"""Autocorrelation and the length of a period."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS, LAGS, BASE, DEFAULT = 20_000, 400, 3, 125


def acf(series: DataFrame, lags: int = LAGS, points: int | None = POINTS) -> DataFrame:
    """series_id, lag and acf of the first ``points`` points (or of all): a join of each point with those at most ``lags`` later, on blocks of the index."""
    first = (series if points is None else series.filter(F.col("idx") < points)).select("series_id", "idx", "value")
    mean = first.groupBy("series_id").agg(F.avg("value").alias("_mean"))
    x = first.join(mean, "series_id").select("series_id", "idx", (F.col("value") - F.col("_mean")).alias("x"))
    size = lags + 1
    left = x.select("series_id", F.floor(F.col("idx") / size).alias("block"), "idx", "x")
    right = x.select("series_id", F.explode(F.array(F.floor(F.col("idx") / size), F.floor(F.col("idx") / size) - 1)).alias("block"), F.col("idx").alias("later"), F.col("x").alias("y"))
    pairs = left.join(right, ["series_id", "block"]).filter(F.col("later").between(F.col("idx"), F.col("idx") + lags))
    sums = pairs.groupBy("series_id", (F.col("later") - F.col("idx")).cast("int").alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("_s"))
    zero = sums.filter("lag = 0").select("series_id", F.col("_s").alias("_zero"))
    return sums.join(zero, "series_id").filter("_zero > 0").select("series_id", "lag", (F.col("_s") / F.col("_zero")).alias("acf"))


def peaks(correlations: DataFrame) -> DataFrame:
    """series_id, ordinal (from 0), lag and acf of the strict local maxima beyond lag BASE."""
    order = Window.partitionBy("series_id").orderBy("lag")
    kept = correlations.filter(F.col("lag") >= BASE)
    tops = kept.withColumn("_a", F.lag("acf").over(order)).withColumn("_b", F.lead("acf").over(order)).filter("acf > _a AND acf > _b")
    return tops.select("series_id", (F.row_number().over(order) - 1).alias("ordinal"), "lag", "acf")


def period(series: DataFrame, rank: int = 1, points: int | None = POINTS) -> DataFrame:
    """series_id and period: the lag of the highest peak (rank 1) or of the next highest that come later (2, 3).

    A peak within BASE lags of the first or over 300 lags after it, and a series without peaks, gives DEFAULT; rank 0 gives 1.
    """
    names = series.select("series_id").distinct()
    if rank == 0:
        return names.withColumn("period", F.lit(1))
    found = peaks(acf(series, points=points)).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("acf")).alias("h"), "ordinal", "lag"))).alias("tops"))
    # At most LAGS peaks a series, from the highest down.
    tops = F.col("tops")
    highest = F.element_at(tops, 1)
    if rank == 1:
        chosen = highest["lag"]
    else:
        second = F.coalesce(F.get(F.filter(F.slice(tops, 2, LAGS), lambda t: t["ordinal"] > highest["ordinal"]), F.lit(0)), highest)
        if rank == 2:
            chosen = second["lag"]
        else:
            # The third starts at the place in the order of heights that the second's ordinal names.
            start = F.element_at(tops, F.least(second["ordinal"] + 1, F.size(tops)))
            rest = F.filter(F.slice(tops, second["ordinal"] + 1, LAGS), lambda t: t["ordinal"] > start["ordinal"])
            chosen = F.coalesce(F.get(rest, F.lit(0)), highest)["lag"]
    place = chosen - BASE
    lengths = found.select("series_id", F.when(place.between(3, 300), chosen).otherwise(DEFAULT).alias("_period"))
    return names.join(lengths, "series_id", "left").select("series_id", F.coalesce("_period", F.lit(DEFAULT)).cast("int").alias("period"))


def spectrum(series: DataFrame) -> DataFrame:
    """series_id, n, freq (1 to n / 2) and amplitude of the discrete Fourier transform of each series.

    In two steps over n = a * b points, a the largest divisor of n up to its root: transforms of the b points that have
    the same remainder by a, turned, and transforms of the a results of each frequency of those.  Both steps are groups
    of a part of the series only (for a prime n, of the whole).
    """
    sizes = series.groupBy("series_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("a", F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n"))), lambda d: F.col("n") % d == 0)))
    rows = series.select("series_id", "idx", "value").join(sizes, "series_id").withColumn("r", F.col("idx") % F.col("a"))

    def inner(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n, r = t["n"][0].as_py(), t["r"][0].as_py()
        y = np.fft.fft(t["value"].to_numpy())
        k = np.arange(len(y))
        y = y * np.exp(-2j * np.pi * ((r * k) % n) / n)
        same = lambda c: t[c].combine_chunks()[:1].take(pa.array(np.zeros(len(y), int)))
        return pa.table({"series_id": same("series_id"), "n": same("n"), "r": same("r"), "k": k, "re": y.real, "im": y.imag})

    def outer(t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        n, k = t["n"][0].as_py(), t["k"][0].as_py()
        z = np.abs(np.fft.fft(t["re"].to_numpy() + 1j * t["im"].to_numpy()))
        freq = np.arange(len(z)) * (n // len(z)) + k
        keep = (freq >= 1) & (freq <= n // 2)
        return pa.table({"series_id": t["series_id"].combine_chunks()[:1].take(pa.array(np.zeros(int(keep.sum()), int))), "n": np.full(int(keep.sum()), n), "freq": freq[keep].astype(np.int32), "amplitude": z[keep]})

    turned = rows.groupBy("series_id", "r").applyInArrow(inner, "series_id string, n long, r long, k long, re double, im double")
    return turned.groupBy("series_id", "k").applyInArrow(outer, "series_id string, n long, freq int, amplitude double")


def spectrum_periods(series: DataFrame, k: int) -> DataFrame:
    """The k strongest frequencies of each series (without the mean) and their periods."""
    order = Window.partitionBy("series_id").orderBy(F.desc("amplitude"), "freq")
    return spectrum(series).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("series_id", "rank", "freq", F.floor(F.col("n") / F.col("freq")).cast("int").alias("period"), "amplitude")
