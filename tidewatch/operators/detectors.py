"""Detectors as joins, windows and groupings: series in, scores (series_id, idx, score) out; higher is more anomalous.

``values`` stands for rows (series_id, idx, lag, value): the normalised components of windows or channels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.frames import edge_pad, min_fill_pad, minmax, ratio, windows, zscore, zscore_lags
from tidewatch.operators.ranks import at_or_below
from tidewatch.operators.segments import overlapping
from tidewatch.sources.lineage import materialise


def window_values(series: DataFrame, width: int) -> DataFrame:
    """Windows with each lag normalised over all windows."""
    return zscore_lags(windows(series, width))


def channel_values(series: DataFrame) -> DataFrame:
    return series.select("series_id", "idx", F.posexplode("features").alias("lag", "value"))


def hbos(values: DataFrame, bins: int = 10, alpha: float = 0.1, tol: float = 0.5) -> DataFrame:
    """Sum over columns of -log2(density + alpha) of each value's bin in a histogram of equal bins.

    Bins are counted closed on the left and looked up closed on the right; the least value counts as in the first bin.
    ``tol`` is how far, in bins, a value may lie outside the histogram and still count as in its first or last bin; no
    value that the histogram was made of lies outside, so it changes nothing here.
    """
    ends = values.groupBy("series_id", "lag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    # A constant column has a range of one around it.
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("series_id", "lag", "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rows = values.join(ends, ["series_id", "lag"]).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    place = (F.col("value") - F.col("lo")) / F.col("width")
    rows = rows.withColumn("left_bin", F.least(F.floor(place), F.lit(bins - 1))).withColumn("right_bin", F.greatest(F.least(F.ceil(place) - 1, F.lit(bins - 1)), F.lit(0)))
    density = rows.groupBy("series_id", "lag", F.col("left_bin").alias("bin")).agg((F.count("*") / F.first("n") / F.first("width")).alias("density"))
    looked = rows.withColumnRenamed("right_bin", "bin").join(density, ["series_id", "lag", "bin"], "left")
    return looked.groupBy("series_id", "idx").agg(F.sum(-F.log2(F.coalesce("density", F.lit(0.0)) + alpha)).alias("score"))


def copod(values: DataFrame) -> DataFrame:
    """Copula-based score: per column the rarity (-ln of the empirical distribution) in the tail that its skew names, or the mean of both tails if more."""
    column = ["series_id", "lag"]
    ranks = at_or_below(values, column, "value").select(*column, "value", (-F.log(F.col("below") / F.col("n"))).alias("l"), (-F.log(F.col("above") / F.col("n"))).alias("r"))
    skews = values.groupBy(*column).agg(F.signum(F.coalesce(F.skewness("value"), F.lit(0.0))).alias("side"))
    sides = values.join(ranks, [*column, "value"]).join(skews, column)
    named = F.when(F.col("side") > 0, F.col("r")).when(F.col("side") < 0, F.col("l")).otherwise(F.col("l") + F.col("r"))
    return sides.groupBy("series_id", "idx").agg(F.sum(F.greatest(named, (F.col("l") + F.col("r")) / 2)).alias("score"))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


#: Points in a block; a block meets another in one step of a task.
BLOCK = 4_096
#: Bytes of the blocks that a task holds while others pass by.
HELD = 64 << 20
#: Distances of points by name.
METRICS = ("euclidean", "manhattan")


def _pack(rows: pa.Table, k: int, copies: bool) -> pa.Table:
    """A block as one row.  First come its ``m`` candidates: without ``copies`` those that are not behind k + 1 equal points of smaller index, as no point needs more of them."""
    idx = rows["idx"].to_numpy()
    order = np.argsort(idx, kind="stable")
    x, idx = np.stack([np.asarray(v, float) for v in rows["v"].to_pylist()])[order], idx[order]
    first = np.ones(len(x), bool)
    if not copies:
        _, of = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        first[by] = np.arange(len(x)) - np.searchsorted(of.ravel()[by], of.ravel()[by]) <= k
    order = np.argsort(~first, kind="stable")
    return pa.table({"series_id": pa.array([rows["series_id"][0].as_py()], pa.string()), "b": rows["b"][:1], "n": pa.array([len(x)]), "m": pa.array([int(first.sum())]), "at": pa.array([idx[order].astype(np.int64).tobytes()], pa.binary()), "v": pa.array([x[order].tobytes()], pa.binary())})


class _Best:
    """The k nearest so far of each point of a block."""

    def __init__(self, own: np.ndarray, x: np.ndarray, k: int, apart: int, past: bool, metric: str):
        self.own, self.x, self.k, self.apart, self.past, self.metric = own, x, k, apart, past, metric
        self.total, self.other = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        self.shift = x.mean(axis=0)
        if metric != "euclidean" or not np.isfinite(self.shift).all():
            self.shift = np.zeros(x.shape[1])

    def _allowed(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (np.abs(at - other) > self.apart) & ((other < at) if self.past else (other != at))

    def meet(self, other: np.ndarray, y: np.ndarray) -> None:
        """Another block: those that a product of matrices can't tell from the k-th are worked out again value by value."""
        squared = self.metric == "euclidean"
        a, b = self.x - self.shift, y - self.shift
        left, right = ((a * a).sum(axis=1), (b * b).sum(axis=1)) if squared else (np.abs(a).sum(axis=1), np.abs(b).sum(axis=1))
        most = max(left[np.isfinite(left)].max(initial=0), right[np.isfinite(right)].max(initial=0))
        # Single precision where its range does; slack is what rounding may add, for vectors of these lengths.
        single = squared and 1e-20 < most < 1e30 and bool(np.isfinite(left).all() and np.isfinite(right).all())
        slack = (2.4e-7 if single else 1e-14) * (a.shape[1] + 8) * 2 * most
        kind = np.float32 if single else float
        turned, right = np.ascontiguousarray((-2 * b).astype(kind).T), right.astype(kind)
        for i in range(0, len(self.own), 256):
            rows = slice(i, i + 256)
            if squared:
                near = a[rows].astype(kind) @ turned
                near += right
            else:
                near = sum((np.abs(a[rows, d, None] - b[None, :, d]) for d in range(a.shape[1])), np.zeros((len(a[rows]), len(b))))
            limit = self.total[rows, -1] - (left[rows] if squared else 0)
            open_ = np.flatnonzero(np.isinf(self.total[rows, -1]))
            if len(open_) and near.shape[1] >= self.k:  # fewer than k so far: no more than the k-th of this block
                some = np.where(self._allowed(self.own[rows][open_, None], other), near[open_], np.inf)
                limit[open_] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + slack
            r, c = np.nonzero(near <= (limit + slack).astype(kind)[:, None])
            ok = self._allowed(self.own[rows][r], other[c])
            if ok.any():
                self._add(i + r[ok], c[ok], other, y)

    def _add(self, r: np.ndarray, c: np.ndarray, other: np.ndarray, y: np.ndarray) -> None:
        total = np.zeros(len(r))
        for d in range(y.shape[1]):  # in order, as a plain sum over the array would
            step = self.x[r, d] - y[c, d]
            total += step * step if self.metric == "euclidean" else np.abs(step)
        own = np.unique(r)
        rows, totals, others = np.concatenate([r, np.repeat(own, self.k)]), np.concatenate([total, self.total[own].ravel()]), np.concatenate([other[c], self.other[own].ravel()])
        order = np.lexsort((others, totals, rows))
        rows, totals, others = rows[order], totals[order], others[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.total[own], self.other[own] = totals[first].reshape(-1, self.k), others[first].reshape(-1, self.k)

    def table(self, series: str) -> pa.RecordBatch:
        r, c = np.nonzero(self.other != np.iinfo(np.int64).max)
        dist = self.total[r, c]
        return pa.RecordBatch.from_pydict({"series_id": pa.array([series] * len(r), pa.string()), "idx": self.own[r], "other": self.other[r, c], "dist": np.sqrt(dist) if self.metric == "euclidean" else dist})


def neighbours(points: DataFrame, k: int, apart: int = 0, past: bool = False, metric: str = "euclidean") -> DataFrame:
    """series_id, idx, rank, other and dist of the k nearest points (array column v) of the series; ties to the smaller index.

    Points come in blocks of about BLOCK, one row each, written to the checkpoint folder once.  A task holds some of them
    (HELD bytes) and reads others one after the other; blocks are read as often as needed but written no more than that,
    so disk grows with the points and with k rows for each point and each HELD bytes, while the work is that of all pairs.
    ``apart``: others must be further away in idx; ``past``: only earlier ones.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}: {', '.join(METRICS)}")
    spark = points.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = points.groupBy("series_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    dealt = points.select("series_id", F.col("idx").cast("long").alias("idx"), "v").join(sizes, "series_id").select("series_id", F.pmod(F.xxhash64("idx"), F.col("_blocks")).cast("int").alias("b"), "idx", "v")
    whole = apart > 0 or past
    # By a number, so that small tables aren't put in one task: it is the computation that counts.
    packed = dealt.repartition(tasks, "series_id", "b").groupBy("series_id", "b").applyInArrow(lambda t: _pack(t, k, whole), "series_id string, b int, n long, m long, at binary, v binary")
    blocks = materialise(packed)
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    held = max(min(count, 2), ceil(size / HELD), 1)
    passing = max(1, min(count, ceil(4 * tasks / held)))
    other = blocks.select(F.col("series_id").alias("_series"), F.col("m").alias("_m"), F.col("at").alias("_at"), F.col("n").alias("_n"), F.col("v").alias("_v")).repartition(held)
    pairs = blocks.drop("m").repartition(passing).join(other.hint("shuffle_replicate_nl"), F.col("series_id") == F.col("_series")).drop("_series")

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch["series_id"][i].as_py(), batch["b"][i].as_py())
                if here != at:
                    if best:
                        yield best.table(at[0])
                    n, at = batch["n"][i].as_py(), here
                    best = _Best(np.frombuffer(batch["at"][i].as_buffer(), np.int64), np.frombuffer(batch["v"][i].as_buffer()).reshape(n, -1).copy(), k, apart, past, metric)
                n, m = batch["_n"][i].as_py(), batch["_m"][i].as_py()
                best.meet(np.frombuffer(batch["_at"][i].as_buffer(), np.int64)[:m], np.frombuffer(batch["_v"][i].as_buffer()).reshape(n, -1)[:m])
        if best:
            yield best.table(at[0])

    found = pairs.mapInArrow(nearest, "series_id string, idx long, other long, dist double")
    order = Window.partitionBy("series_id", "idx").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("series_id", "idx", "rank", "other", "dist")


def knn(points: DataFrame, k: int = 5, method: str = "largest", metric: str = "euclidean") -> DataFrame:
    how = {"largest": F.max("dist"), "mean": F.avg("dist"), "median": F.median("dist")}[method]
    return neighbours(points, k, metric=metric).groupBy("series_id", "idx").agg(how.alias("score"))


def lof(points: DataFrame, k: int = 20, metric: str = "euclidean") -> DataFrame:
    """Local outlier factor: the neighbours' local reachability density over the point's own."""
    near = materialise(neighbours(points, k, metric=metric))
    reach = near.groupBy("series_id", F.col("idx").alias("other")).agg(F.max("dist").alias("k_dist"))
    density = near.join(reach, ["series_id", "other"]).groupBy("series_id", "idx").agg((1 / (F.avg(F.greatest("k_dist", "dist")) + 1e-10)).alias("lrd"))
    theirs = near.join(density.select("series_id", F.col("idx").alias("other"), F.col("lrd").alias("their_lrd")), ["series_id", "other"])
    return theirs.groupBy("series_id", "idx").agg(F.avg("their_lrd").alias("m")).join(density, ["series_id", "idx"]).select("series_id", "idx", (F.col("m") / F.col("lrd")).alias("score"))


def cof(points: DataFrame, k: int = 10) -> DataFrame:
    """Connectivity-based outlier factor: the average chaining distance over that of the neighbours."""
    near = materialise(neighbours(points, k))
    vectors = points.select("series_id", F.col("idx").alias("other"), F.col("v").alias("u"))
    at = near.join(vectors, ["series_id", "other"]).groupBy("series_id", "idx").agg(F.sort_array(F.collect_list(F.struct("rank", "dist", "u"))).alias("at"))
    # The h-th neighbour costs its distance, or that to one of the nearer neighbours if less.
    cost = lambda p, h: F.least(p["dist"], F.coalesce(F.array_min(F.transform(F.slice("at", F.lit(1), h), lambda q: F.sqrt(_squared(q["u"], p["u"])))), p["dist"]))
    costs = F.transform("at", lambda p, h: F.lit(2.0) * (k - h) / ((k + 1) * k) * cost(p, h))
    chain = at.select("series_id", "idx", F.aggregate(costs, F.lit(0.0), lambda x, y: x + y).alias("ac"))
    sums = near.join(chain.select("series_id", F.col("idx").alias("other"), F.col("ac").alias("their")), ["series_id", "other"]).groupBy("series_id", "idx").agg(F.sum("their").alias("s"))
    return chain.join(sums, ["series_id", "idx"]).select("series_id", "idx", ratio(F.col("ac") * k, F.col("s")).alias("score"))


def profile_distances(series: DataFrame, width: int, left_only: bool = False) -> DataFrame:
    """series_id, idx and score of each window: the least z-normalised distance to a window outside the exclusion zone of width / 4 (or only to earlier ones)."""
    wins = windows(series, width)
    mean = F.aggregate("window", F.lit(0.0), lambda a, v: a + v) / width
    points = wins.withColumn("_mean", mean).withColumn("_std", F.sqrt(F.greatest(F.aggregate(F.transform("window", lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))), F.lit(0.0), lambda a, v: a + v) / width, F.lit(0.0))))
    points = points.select("series_id", "idx", F.expr("transform(window, v -> CASE WHEN _std < 1e-12 THEN 0D ELSE (v - _mean) / _std END)").alias("v"))
    return neighbours(points, 1, apart=ceil(width / 4), past=left_only).select("series_id", "idx", F.col("dist").alias("score"))


def matrix_profile(series: DataFrame, width: int) -> DataFrame:
    return min_fill_pad(profile_distances(series, width), series, width)


def left_profile(series: DataFrame, width: int, warm_up: int) -> DataFrame:
    """Distances to the past only; 0 in the warm-up and where no window lies in the past."""
    past = profile_distances(series, width, left_only=True).withColumn("idx", F.col("idx") + width - 1)
    return series.select("series_id", "idx").join(past, ["series_id", "idx"], "left").select("series_id", "idx", F.when(F.col("idx") < warm_up, 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def fft_regions(series: DataFrame, keep: int = 5, neighbourhood: int = 21, limit: float = 0.6, gap: int = 10) -> DataFrame:
    """Regions of nearby local outliers: points whose residual is over the mean residual, by how far they stand off their surroundings.

    The transform runs along the single channel, so the residual is the normalised value itself, but for the first ``keep`` points (0).
    """
    z = zscore(series)
    order, half = Window.partitionBy("series_id").orderBy("idx"), neighbourhood // 2
    rows = z.select("series_id", "idx", F.when(F.col("idx") < keep, 0.0).otherwise(F.abs("value")).alias("so"), (F.col("value") - F.avg("value").over(order.rowsBetween(-half, half))).alias("off"))
    mean = rows.groupBy("series_id").agg(F.avg("so").alias("mso"))
    local = rows.join(mean, "series_id").filter("so > mso")
    stats = local.groupBy("series_id").agg(F.avg("off").alias("m"), (F.stddev_pop("off") + 1e-6).alias("s"))
    outliers = local.join(stats, "series_id").select("series_id", "idx", ((F.col("off") - F.col("m")) / F.col("s")).alias("z")).filter(F.abs("z") > limit)
    new = F.coalesce((F.col("idx") - F.lag("idx").over(order) > gap).cast("int"), F.lit(1))
    regions = outliers.withColumn("_new", new).withColumn("region", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("series_id", "region").agg(F.min("idx").alias("s"), F.max("idx").alias("e"), F.avg(F.abs("z")).alias("score"), F.count("*").alias("n")).filter("n > 1")
    inside = regions.select("series_id", F.explode(F.sequence("s", "e")).alias("idx"), "score")
    return series.select("series_id", "idx").join(inside, ["series_id", "idx"], "left").select("series_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def poly_blocks(series: DataFrame, width: int, neighbourhood: int = 600, power: int = 1) -> DataFrame:
    """Fit a polynomial to the surroundings of each block of ``width`` points without the block, and give its points the size of the residual.

    Values are scaled to 0..1.  The first min(500, n / 10) points' blocks score 0; the curve is taken at places stretched so that the last is the block's end.
    A fit is made of sums of powers of the places, so only as many numbers as it has coefficients leave the points.
    """
    scaled = minmax(series).select("series_id", "idx", "value")
    n = scaled.groupBy("series_id").agg(F.count("*").alias("n"))
    n = n.withColumn("hood", F.least(F.lit(neighbourhood), F.col("n"))).withColumn("last", F.floor(F.col("n") / width)).withColumn("first", F.ceil(F.least(F.lit(500), F.floor(F.col("n") * 0.1)) / width))
    blocks = n.filter("first <= last").withColumn("block", F.explode(F.sequence("first", "last"))).withColumn("at", F.col("block") * width).filter("at < n")
    half = F.floor(F.col("hood") / 2)
    middle = (F.col("at") + half < F.col("n")) & (F.col("at") - half > 0)
    late = F.col("at") + half >= F.col("n")
    lo = F.when(middle, F.col("at") - half).when(late, F.col("n") - F.col("hood")).otherwise(F.lit(0))
    hi = F.when(middle, F.col("at") + half).when(late, F.col("n")).otherwise(F.col("hood"))
    blocks = blocks.select("series_id", "block", "at", "n", lo.alias("lo"), (hi - 1).alias("hi"))
    points = scaled.select("series_id", F.col("idx").alias("p"), "idx", "value")
    near = overlapping(blocks, points, ("lo", "hi"), ("idx", "p")).filter(~F.col("idx").between(F.col("at"), F.col("at") + width - 1))
    # Places in units of the surroundings, from -1 to 1, so that high powers stay comparable.
    unit = lambda place: (place - (F.col("lo") + F.col("hi")) / 2) / F.greatest((F.col("hi") - F.col("lo")) / 2, F.lit(1.0))
    x = unit(F.col("idx"))
    sums = [F.sum(F.pow(x, F.lit(i))).alias(f"x{i}") for i in range(2 * power + 1)] + [F.sum(F.pow(x, F.lit(i)) * F.col("value")).alias(f"y{i}") for i in range(power + 1)]
    totals = near.groupBy("series_id", "block", "at", "n", "lo", "hi").agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        m = np.column_stack([c.to_numpy(float) for c in columns])
        moments = np.stack([m[:, i : i + power + 1] for i in range(power + 1)], axis=1)
        right = m[:, 2 * power + 1 :]
        return pd.Series([np.linalg.lstsq(a, b, rcond=None)[0].tolist() for a, b in zip(moments, right)])

    names = [f"x{i}" for i in range(2 * power + 1)] + [f"y{i}" for i in range(power + 1)]
    curves = totals.withColumn("c", solve(*names)).drop(*names)
    inside = overlapping(curves.withColumn("end", F.col("at") + width - 1), points, ("at", "end"), ("idx", "p"))
    stretch = F.when(F.col("at") + width <= F.col("n"), F.col("at") + (F.col("idx") - F.col("at")) * (width / max(width - 1, 1))).otherwise(F.col("idx"))
    place = unit(stretch)
    fit = F.lit(0.0)
    for i in range(power, -1, -1):
        fit = fit * place + F.col("c")[i]
    residual = F.col("value") - fit
    sizes = inside.groupBy("series_id", "block", "at").agg(F.sqrt(F.sum(residual * residual) / F.count("*")).alias("score"))
    spread = sizes.select("series_id", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("idx"), "score")
    return series.select("series_id", "idx").join(spread, ["series_id", "idx"], "left").select("series_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def sub_hbos(series: DataFrame, width: int, bins: int = 10, alpha: float = 0.1, tol: float = 0.5) -> DataFrame:
    return edge_pad(hbos(window_values(series, width), bins, alpha, tol), series, width)


def window_points(series: DataFrame, width: int) -> DataFrame:
    """Windows as points (array column v), each lag normalised over all windows.

    Mean and deviation of each lag are summed up before anything is shuffled; the windows stay as they are.
    """
    wins = windows(series, width)
    lags = wins.select("series_id", F.posexplode("window").alias("lag", "value")).groupBy("series_id", "lag").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    figures = lags.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("lag", "m", "s"))).alias("_figures"))
    scaled = F.zip_with("window", "_figures", lambda v, f: F.when(f["s"] > 0, (v - f["m"]) / F.when(f["s"] > 0, f["s"])).otherwise(F.lit(0.0)))
    return wins.join(figures, "series_id").select("series_id", "idx", scaled.alias("v"))


def channel_points(series: DataFrame) -> DataFrame:
    """Rows of channels as points, each row normalised by itself."""
    from tidewatch.operators.frames import zscore_rows

    return zscore_rows(series.select("series_id", "idx", "features"), "features").select("series_id", "idx", F.col("features").alias("v"))
