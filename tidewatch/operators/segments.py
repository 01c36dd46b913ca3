"""Runs of labelled or predicted points, their buffers and overlaps.

Points are dealt to buckets of ``BUCKET`` indices, so that a long series is the work of many tasks; only what a bucket
is reduced to (its runs) is put in order over a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Indices of a series in a bucket.
BUCKET = 8_192
#: Indices of a bucket in which ranges meet; few of them, as ranges of a bucket are compared pair by pair.
MEET = 256


def bucket(column: str | Column = "idx") -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / BUCKET)


def in_runs(points: DataFrame, flag: str = "label", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The points with the flag set, with seg_id (from 1), s and e (both inside) of their run."""
    hits = points.filter(F.col(flag) > 0).withColumn("_bucket", bucket())
    hits = hits.withColumn("_island", F.col("idx") - F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("idx")))
    return hits.join(_islands(hits, keys), [*keys, "_bucket", "_island"]).drop("_bucket", "_island")


def _islands(hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The runs inside each bucket, with seg_id, s and e of the runs of the series that they are part of."""
    local = hits.groupBy(*keys, "_bucket", "_island").agg(F.min("idx").alias("_s"), F.max("idx").alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_s")
    new = F.coalesce((F.lag("_e").over(order) + 1 < F.col("_s")).cast("int"), F.lit(1))
    whole = Window.partitionBy(*keys, "seg_id")
    numbered = local.withColumn("_new", new).withColumn("seg_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.select(*keys, "_bucket", "_island", "seg_id", F.min("_s").over(whole).alias("s"), F.max("_e").over(whole).alias("e"))


def runs(points: DataFrame, flag: str = "label", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys, seg_id (from 1), s and e (both inside): the runs of points with the flag set."""
    hits = points.filter(F.col(flag) > 0).select(*keys, "idx", bucket().alias("_bucket"))
    hits = hits.withColumn("_island", F.col("idx") - F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("idx")))
    return _islands(hits, keys).select(*keys, "seg_id", "s", "e").distinct()


def beside(points: DataFrame, column: str, default: int = 0) -> DataFrame:
    """Add _before and _after: the column of the points of the index before and after; the points of a series follow each other."""
    edge = F.array_distinct(F.array(bucket(F.col("idx") - 1), bucket(), bucket(F.col("idx") + 1)))
    dealt = points.withColumn("_bucket", F.explode(edge))  # the ends of a bucket are also seen by the next one
    order = Window.partitionBy("series_id", "_bucket").orderBy("idx")
    both = dealt.withColumn("_before", F.lag(column, 1, default).over(order)).withColumn("_after", F.lead(column, 1, default).over(order))
    return both.filter(F.col("_bucket") == bucket()).drop("_bucket")


def runs_over(passed: DataFrame) -> DataFrame:
    """series_id, k, q, s and e: the runs of points over each threshold k, where a point is over k if k < passed; q is their begin.

    Runs begin and end where ``passed`` changes, so a run gives one row for its begin and one for its end, whatever its
    length; behind a begin, the next row of the threshold is its end.
    """
    at = beside(passed.select("series_id", "idx", "passed"), "passed")
    edges = lambda other, end: F.transform(F.when(F.col("passed") > F.col(other), F.sequence(F.col(other), F.col("passed") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("k"), F.lit(end).alias("end")))
    rows = at.select("series_id", "idx", F.explode(F.concat(edges("_before", 0), edges("_after", 1))).alias("_x")).select("series_id", "_x.k", "idx", "_x.end")
    following = F.lead("idx").over(Window.partitionBy("series_id", "k").orderBy("idx", "end"))
    return rows.withColumn("e", following).filter("end = 0").select("series_id", "k", F.col("idx").alias("q"), F.col("idx").alias("s"), "e")


def overlapping(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], key: str = "series_id") -> DataFrame:
    """Pairs of rows of a series whose ranges (both ends inside) share an index; columns of both, which differ but for the key.

    Both sides are dealt to the buckets (of MEET indices) that they cover; a pair is given in the first bucket of both.
    """
    place = lambda column: F.floor(F.col(column) / MEET)
    cover = lambda df, ends, name: df.withColumn(name, F.explode(F.sequence(place(ends[0]), place(ends[1]))))
    left = cover(a, a_ends, "_bucket").alias("a")
    right = cover(b.withColumnRenamed(key, "_key"), b_ends, "_b_bucket").alias("b")
    pairs = left.join(right, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b_bucket")))
    meet = (F.col(a_ends[0]) <= F.col(b_ends[1])) & (F.col(b_ends[0]) <= F.col(a_ends[1]))
    return pairs.filter(meet & (F.col("_bucket") == F.greatest(place(a_ends[0]), place(b_ends[0])))).drop("_key", "_bucket", "_b_bucket")


def merged(segments: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """Runs widened by half a window on both sides and joined where they meet; inside [0, n - 1]."""
    half, order = width // 2, Window.partitionBy("series_id").orderBy("s")
    new = F.coalesce((F.lag("e").over(order) + half < F.col("s") - half).cast("int"), F.lit(1))
    grouped = segments.withColumn("_new", new).withColumn("seg", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = grouped.groupBy("series_id", "seg").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return joined.join(sizes, "series_id").select("series_id", F.col("seg").cast("int").alias("seg_id"), F.greatest(F.col("s") - half, F.lit(0)).alias("s"), F.least(F.col("e") + half, F.col("n") - 1).alias("e"))


def soft_labels(points: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """Add soft: the label, and beside each run, up to half a window away, sqrt(1 - distance / width); 1 at most."""
    half = width // 2
    right = segments.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(half)))).select("series_id", (F.col("e") + F.col("d")).alias("idx"), "d") if half else None
    left = segments.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(half)))).select("series_id", (F.col("s") - F.col("d")).alias("idx"), "d") if half else None
    if half:
        near = right.unionByName(left).groupBy("series_id", "idx").agg(F.sum(F.sqrt(1 - F.col("d") / width)).alias("_more"))
        points = points.join(near, ["series_id", "idx"], "left")
    else:
        points = points.withColumn("_more", F.lit(0.0))
    return points.withColumn("soft", F.least(F.lit(1.0), F.col("label") + F.coalesce("_more", F.lit(0.0)))).drop("_more")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of segments of a series that share a point: series_id, a_id, b_id and shared."""
    x = a.select("series_id", F.col("seg_id").alias("a_id"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    y = b.select("series_id", F.col("seg_id").alias("b_id"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return overlapping(x, y, ("a_s", "a_e"), ("b_s", "b_e")).select("series_id", "a_id", "b_id", (F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1).alias("shared"))


def attributes(points: DataFrame) -> DataFrame:
    """What kinds of anomalies a series has: num_anomaly, and whether there are single points or longer runs."""
    return runs(points).groupBy("series_id").agg(F.count("*").alias("num_anomaly"), F.max((F.col("s") == F.col("e")).cast("int")).alias("point_anomaly"), F.max((F.col("s") < F.col("e")).cast("int")).alias("seq_anomaly"))
