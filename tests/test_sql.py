"""The library from SQL gives what the API gives."""

import numpy as np
import pytest

from tidewatch.operators import measures, segments
from tidewatch.plans import sql
from tidewatch.plans.registry import detect


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(np.sin(i / 4) + rng.normal(0, 0.1) + 5 * (50 <= i < 55)), int(50 <= i < 55 or i == 80)) for s in "abc" for i in range(120)]
    rows += [("d", i, 1.0 * i, 0) for i in range(30)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double, label int").repartition(5)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments_by_a_table_function(spark, series):
    sql.register_functions(spark)
    series.createOrReplaceTempView("series")
    got = spark.sql("SELECT series_id, seg_id, s, e FROM anomaly_segments(TABLE(SELECT series_id, idx, label FROM series) PARTITION BY series_id ORDER BY idx)")
    assert rows(got) == rows(segments.runs(series).select("series_id", "seg_id", "s", "e")) and got.count() == 6


def test_thresholds_by_a_table_function(spark, series):
    sql.register_functions(spark)
    series.createOrReplaceTempView("series")
    got = spark.sql("SELECT * FROM score_thresholds(TABLE(SELECT series_id, value FROM series) PARTITION BY (series_id), 5)").filter("series_id = 'd'").orderBy("k")
    assert [r.theta for r in got.collect()] == [0.0, 7.25, 14.5, 21.75, 29.0]


def test_measures_by_views_and_aggregates(spark, series):
    sql.publish(spark, series, {"Sub_PCA": {"width": 10}, "Seasonal": {}})
    scored = detect(series, "Sub_PCA", width=10).select("series_id", "idx", "score").join(series, ["series_id", "idx"])
    want = {r.series_id: r.auc_roc for r in measures.roc_auc(scored).collect()}
    assert {r.series_id: r.auc_roc for r in spark.sql("SELECT series_id, auc_roc FROM measures_sub_pca").collect()} == pytest.approx(want)
    got = {r.series_id: (r.a, r.b) for r in spark.sql("SELECT series_id, auc_roc(score, label) AS a, auc_pr(score, label) AS b FROM scores_sub_pca GROUP BY series_id").collect()}
    assert got["d"] == (None, None) and {s: a for s, (a, _) in got.items()} == pytest.approx(want)
    best = spark.sql("SELECT s.series_id, max_by(m.auc_pr, s.score) AS p FROM scores_seasonal s JOIN measures_seasonal m USING (series_id) WHERE s.label = 1 GROUP BY s.series_id")
    assert {r.series_id for r in best.collect()} == {"a", "b", "c"}
