"""Samples, splits, sketches and small expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import arrays, sums
from tidewatch.operators import frames, measures, sketches
from tidewatch.plans import bench


def points(spark, n=500):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(s, i, float(x)) for s in "ab" for i, x in enumerate(rng.lognormal(size=n))], "series_id string, idx long, value double")


def test_bags_are_the_same_however_the_table_is_cut(spark):
    rows = points(spark)
    bag = lambda df, **kw: sorted((r.series_id, r.idx) for r in frames.bagging(df, 40, 3, **kw).collect())
    got = bag(rows)
    assert got == bag(rows.repartition(7)) and len(got) == len(set(got)) == 80 and got != sorted((r.series_id, r.idx) for r in frames.bagging(rows, 40, 4).collect())
    assert frames.bagging(rows, 900, 3).count() == 1_000
    drawn = bag(rows, replace=True)
    assert drawn == bag(rows.repartition(7), replace=True) and len(drawn) == 80
    assert len(bag(rows.filter("idx < 10"), replace=True)) == 80


def test_split_values_lie_inside(spark):
    values = points(spark).withColumn("lag", F.lit(0))
    ends = {r.series_id: (r.lo, r.hi) for r in values.groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    one, two = ({r.series_id: r.split for r in frames.split_values(values, seed).collect()} for seed in (1, 2))
    assert all(ends[s][0] <= v <= ends[s][1] for s, v in one.items()) and one != two


def test_merged_sketches_know_ranks(spark):
    """Ten days of unlike scores: the rank of a threshold from merged sketches against the exact one."""
    rng = np.random.default_rng(2)
    rows = [("a", d, float(x)) for d in range(10) for x in rng.normal(d, 1 + d, 1_000)]
    scored = spark.createDataFrame(rows, "series_id string, d int, score double").repartition(6)
    days = sketches.daily(scored, F.col("d"))
    assert days.count() == 10 and days.agg(F.sum("n")).first()[0] == 10_000
    x = np.sort([r[2] for r in rows])
    for share in (0.01, 0.1, 0.5):
        theta = sketches.thresholds(days, share).first()
        assert theta.n == 10_000 and abs((x > theta.theta).mean() - share) < 0.02
    some = sketches.thresholds(days.filter("day < 3"), 0.1).first()
    own = np.array([r[2] for r in rows if r[1] < 3])
    assert some.n == 3_000 and abs((own > some.theta).mean() - 0.1) < 0.02
    assert abs(sketches.over_sketched(scored, days, 0.1).agg(F.avg("pred")).first()[0] - 0.1) < 0.02


def test_small_expressions(spark):
    row = spark.createDataFrame([([1, 2, 3], [2, 3, 4], [0.0, 1.0, 2.0, 3.0, 4.0], 1, 2, 256)], "a array<int>, b array<int>, window array<double>, one long, two long, many long")
    got = frames.down_sample(row, 2).select("window", arrays.symmetric_difference(F.col("a"), F.col("b")).alias("s"), *(arrays.expected_path(F.col(c)).alias(c) for c in ("one", "two", "many"))).first()
    assert got.window == [0.0, 2.0, 4.0] and sorted(got.s) == [1, 4]
    assert (got.one, got.two) == (0.0, 1.0) and got.many == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_measures_are_appended_by_detector(spark, tmp_path):
    path = str(tmp_path / "measures")
    rows = spark.createDataFrame([("1", "A", 0.5), ("2", "B", 0.7)], "series_id string, detector string, auc_roc double")
    bench.write_measures(rows, path)
    bench.write_measures(rows.filter("detector = 'A'"), path)
    assert spark.read.parquet(path).groupBy("detector").count().orderBy("detector").collect() == [("A", 2), ("B", 1)]


def test_means_of_equal_groups_are_equal(spark):
    """Days of the same total have the same mean, here one that lies between two numbers of nine places."""
    taxes = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08] * 32
    taxes[0] += 0.01
    orders = {"up": sorted(taxes), "down": sorted(taxes, reverse=True), "apart": sorted(taxes[:-2]) + [0.0, 0.15]}
    rows = spark.createDataFrame([(k, v) for k in orders for v in orders[k]], "day string, tax double").coalesce(1)
    exact = sum(round(v * 100) for v in taxes) / (100 * len(taxes))
    got = {r.day: (r.mean, r.places) for r in rows.groupBy("day").agg(sums.mean("tax").alias("mean")).withColumn("places", F.round("mean", 9)).collect()}
    assert got == dict.fromkeys(orders, (exact, 0.045039063))
    odd = spark.createDataFrame([("a", 1e300), ("a", 2.0), ("b", None), ("c", float("nan")), ("d", 1e-5), ("d", 3e-5), ("e", None), ("e", -0.5), ("f", 3e6)], "day string, tax double")
    means = {r.day: r.mean for r in odd.groupBy("day").agg(sums.mean("tax").alias("mean")).collect()}
    assert np.isnan(means.pop("c")) and means == {"a": pytest.approx(5e299), "b": None, "d": pytest.approx(2e-5), "e": -0.5, "f": 3e6}


def test_limits_do_not_depend_on_the_order_of_rows(spark):
    """Limits are those of whole numbers, bit by bit, and equal scores pass none."""
    parts = np.random.default_rng(3).exponential(5_000, 3_000).round().astype(int)
    spread = 3_000 * int((parts * parts).sum()) - int(parts.sum()) ** 2
    for order in (parts, parts[::-1], np.sort(parts)):
        rows = spark.createDataFrame([(int(c) / 1e4,) for c in order], "v double").coalesce(1)
        got = rows.agg(sums.mean("v"), sums.deviation("v"), sums.deviation("v", 1)).first()
        assert tuple(got) == (int(parts.sum()) / 3e7, (spread / 9e6) ** 0.5 / 1e4, (spread / (3_000.0 * 2_999)) ** 0.5 / 1e4)
    same = spark.createDataFrame([("a", i, 36.3207) for i in range(1_000)] + [("b", 0, 1.5)], "series_id string, idx long, score double")
    assert {r.pred for r in measures.three_sigma(same).collect()} == {0}
    odd = spark.createDataFrame([("a", 1e10), ("a", 1e10), ("b", None), ("d", 1e-5), ("d", 3e-5), ("e", 2.5), ("f", -200_000.0), ("f", 200_000.0)], "k string, v double")
    got = {r.k: (r.p, r.s) for r in odd.groupBy("k").agg(sums.deviation("v").alias("p"), sums.deviation("v", 1).alias("s")).collect()}
    assert got == {"a": (0, 0), "b": (None, None), "d": (pytest.approx(1e-5), pytest.approx(2**0.5 * 1e-5)), "e": (0, None), "f": (2e5, pytest.approx(2**0.5 * 2e5))}
