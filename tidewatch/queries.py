"""The queries of the anomaly-detection part, each over whole tables, and their SQL for DuckDB.

Figures that sum floating-point numbers are rounded to six places, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import arrays
from tidewatch.operators import detectors as d
from tidewatch.operators import distances as dist
from tidewatch.operators import features as ft
from tidewatch.operators import frames as fr
from tidewatch.operators import measures as m
from tidewatch.operators import period as pe
from tidewatch.operators import seasons
from tidewatch.operators import segments as sg
from tidewatch.operators import sketches as sk
from tidewatch.plans import bench, fitted, sql
from tidewatch.plans.registry import REGISTRY, detect
from tidewatch.sources import series as s
from tidewatch.sources.lineage import materialise, scratch
from tidewatch.sources.sink import ScoreSink
from tidewatch.streaming import features as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The series as DuckDB builds them.
TABLES = """
ts_u AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value,
    CASE WHEN day(ts) % 7 = 3 AND hour(ts) BETWEEN 6 AND 11 THEN 1 ELSE 0 END AS label FROM events),
ts_h AS (SELECT 'hourly' AS series_id, row_number() OVER (ORDER BY hr) - 1 AS idx, value, label FROM (
    SELECT date_trunc('hour', ts) AS hr, avg(value) AS value, max(CASE WHEN day(ts) % 7 = 3 AND hour(ts) BETWEEN 6 AND 11 THEN 1 ELSE 0 END) AS label FROM events GROUP BY 1)),
ts_d AS (SELECT 'daily' AS series_id, row_number() OVER (ORDER BY o_orderdate) - 1 AS idx, value,
    CASE WHEN day(o_orderdate) = 13 OR month(o_orderdate) = 7 AND day(o_orderdate) <= 5 THEN 1 ELSE 0 END AS label FROM (
    SELECT o_orderdate, sum(o_totalprice) AS value FROM orders GROUP BY 1)),
ts_m AS (SELECT 'shipments' AS series_id, row_number() OVER (ORDER BY l_shipdate) - 1 AS idx, c0, c1, c2, c3 FROM (
    SELECT l_shipdate, avg(l_quantity) AS c0, avg(l_extendedprice) AS c1, avg(l_discount) AS c2, avg(l_tax) AS c3 FROM lineitem GROUP BY 1)),
lags_m AS (SELECT series_id, idx, 0 AS lag, c0 AS value FROM ts_m UNION ALL SELECT series_id, idx, 1, c1 FROM ts_m UNION ALL SELECT series_id, idx, 2, c2 FROM ts_m UNION ALL SELECT series_id, idx, 3, c3 FROM ts_m),
vec AS (SELECT 'vec' AS series_id, vec_id AS idx, embedding::DOUBLE[] AS v, (label = 3)::INTEGER AS label FROM embeddings)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            text = sql.removeprefix("RECURSIVE")
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if text != sql else ''}{TABLES}{',' if text.lstrip()[:6] != 'SELECT' else ''} {text}"
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Sources


@query("scan_series", "SELECT series_id, idx, value, label FROM ts_u")
def scan_series(spark: SparkSession, sf: str) -> DataFrame:
    return s.event_series(spark, sf).drop("ts")


@query("csv_lines", "SELECT series_id, idx, value, label FROM ts_h")
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly series as a file of lines (hours, which don't grow with the events, so one task may write them) and back, in pieces by several tasks."""
    folder = scratch(spark, "csv")
    h = s.hourly_series(spark, sf)
    lines = h.repartitionByRange(1, "idx").sortWithinPartitions("idx").select("value", F.col("label").alias("Label"))
    lines.write.csv(folder, header=True)
    return s.csv_series(spark, folder).select(F.lit("hourly").alias("series_id"), "idx", "value", "label")


@query("name_metadata", r"""SELECT file_name, regexp_extract(file_name, '^(\d+)_', 1)::INTEGER AS series_no, regexp_extract(file_name, '^\d+_(.+)_id_', 1) AS dataset, regexp_extract(file_name, '_id_(\d+)_', 1)::INTEGER AS id,
    regexp_extract(file_name, '_id_\d+_(\w+)_tr_', 1) AS domain, regexp_extract(file_name, '_tr_(\d+)_', 1)::INTEGER AS train_index, regexp_extract(file_name, '_1st_(\d+)', 1)::INTEGER AS first_anomaly
    FROM (SELECT lpad(c_custkey::VARCHAR, 6, '0') || '_' || c_mktsegment || '_id_' || c_nationkey || '_Facility_tr_' || (500 + c_custkey) || '_1st_' || (900 + c_custkey) || '.csv' AS file_name FROM customer)""")
def name_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    name = F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("_"), "c_mktsegment", F.lit("_id_"), "c_nationkey", F.lit("_Facility_tr_"), F.col("c_custkey") + 500, F.lit("_1st_"), F.col("c_custkey") + 900, F.lit(".csv"))
    return s.name_metadata(c.select(name.alias("file_name")))


@query("series_profile", "SELECT series_id, count(*) AS n, sum(label)::BIGINT AS positives, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ts_u GROUP BY 1")
def series_profile(spark: SparkSession, sf: str) -> DataFrame:
    return s.profile(s.event_series(spark, sf))


@query("point_labels", """, x AS (SELECT event_type AS series_id, (coalesce((props->>'$.k')::INTEGER, 0) >= 95)::INTEGER AS label FROM events)
    SELECT series_id, sum(label)::BIGINT AS positives FROM x GROUP BY 1""".lstrip(", "))
def point_labels(spark: SparkSession, sf: str) -> DataFrame:
    return s.event_series(spark, sf, s.point_label()).groupBy("series_id").agg(F.sum("label").cast("long").alias("positives"))


# Frames

WINDOWS = "w AS (SELECT a.series_id, a.idx, b.idx - a.idx AS lag, b.value FROM ts_h a JOIN ts_h b ON b.idx BETWEEN a.idx AND a.idx + 4 WHERE a.idx <= (SELECT max(idx) - 4 FROM ts_h))"
MEANS = WINDOWS + ", sc AS (SELECT series_id, idx, avg(value) AS score FROM w GROUP BY 1, 2), n AS (SELECT max(idx) AS last, count(*) AS n FROM sc)"


def window_means(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = s.hourly_series(spark, sf)
    return fr.windows(h, 5).select("series_id", "idx", fr.mean_of(F.col("window")).alias("score")), h


@query("windows_w5", WINDOWS + " SELECT series_id, idx, lag::INTEGER AS lag, round(value, 6) AS value FROM w")
def windows_w5(spark: SparkSession, sf: str) -> DataFrame:
    w = fr.windows(s.hourly_series(spark, sf), 5)
    return rounded(w.select("series_id", "idx", F.posexplode("window").alias("lag", "value")), "value")


@query("windows_channels", "SELECT a.series_id, a.idx, (3 * a.lag + b.idx - a.idx)::INTEGER AS place, round(b.value, 6) AS value FROM lags_m a JOIN lags_m b ON a.lag = b.lag AND b.idx BETWEEN a.idx AND a.idx + 2 WHERE a.idx % 2 = 0 AND a.idx <= (SELECT max(idx) - 2 FROM ts_m)")
def windows_channels(spark: SparkSession, sf: str) -> DataFrame:
    w = fr.windows(s.shipment_series(spark, sf), 3, stride=2)
    return rounded(w.select("series_id", "idx", F.posexplode("window").alias("place", "value")), "value")


@query("forecast_pairs", "SELECT a.series_id, a.idx, round(b.value, 6) AS target FROM ts_h a JOIN ts_h b ON b.idx = a.idx + 24")
def forecast_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fr.forecast_pairs(s.hourly_series(spark, sf), 24).select("series_id", "idx", F.round(F.col("target")[0], 6).alias("target"))


@query("zscore", "SELECT series_id, idx, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM ts_u WINDOW w AS (PARTITION BY series_id)")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fr.zscore(s.event_series(spark, sf)).select("series_id", "idx", "value"), "value")


@query("zscore_col", WINDOWS + " SELECT series_id, idx, lag::INTEGER AS lag, round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 6) AS value FROM w WINDOW p AS (PARTITION BY series_id, lag)")
def zscore_col(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fr.zscore_lags(fr.windows(s.hourly_series(spark, sf), 5)), "value")


ROWS = "z AS (SELECT series_id, idx, lag, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS value FROM lags_m WINDOW p AS (PARTITION BY series_id, idx))"


@query("zscore_row", ROWS + " SELECT series_id, idx, lag, round(value, 6) AS value FROM z")
def zscore_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.zscore_rows(s.shipment_series(spark, sf), "features")
    return rounded(rows.select("series_id", "idx", F.posexplode("features").alias("lag", "value")), "value")


@query("minmax", "SELECT series_id, idx, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM ts_u WINDOW w AS (PARTITION BY series_id)")
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fr.minmax(s.event_series(spark, sf)).select("series_id", "idx", "value"), "value")


@query("minmax_row", WINDOWS + " SELECT series_id, idx, lag::INTEGER AS lag, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p), 6) AS value FROM w WINDOW p AS (PARTITION BY series_id, idx)")
def minmax_row(spark: SparkSession, sf: str) -> DataFrame:
    w = fr.minmax_rows(fr.windows(s.hourly_series(spark, sf), 5))
    return rounded(w.select("series_id", "idx", F.posexplode("window").alias("lag", "value")), "value")


@query("standardise_train", "t AS (SELECT lag, avg(value) AS mean, stddev_pop(value) AS std FROM lags_m WHERE idx < 0.3 * (SELECT count(*) FROM ts_m) GROUP BY 1) SELECT series_id, idx, lag AS channel, round((value - mean) / greatest(std, 1e-8), 6) AS value FROM lags_m JOIN t USING (lag)")
def standardise_train(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    ms = s.shipment_series(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    return rounded(fr.standardise(ms, F.col("idx") < 0.3 * F.col("n")), "value")


@query("edge_pad", MEANS + " SELECT h.series_id, h.idx, round(sc.score, 6) AS score FROM ts_h h, n JOIN sc ON sc.idx = least(greatest(h.idx - 2, 0), n.last)")
def edge_pad(spark: SparkSession, sf: str) -> DataFrame:
    scores, h = window_means(spark, sf)
    return rounded(fr.edge_pad(scores, h, 5), "score")


@query("left_hold_pad", MEANS + " SELECT h.series_id, h.idx, round(coalesce(sc.score, 0), 6) AS score FROM ts_h h LEFT JOIN sc ON sc.idx = h.idx - 5")
def left_hold_pad(spark: SparkSession, sf: str) -> DataFrame:
    scores, h = window_means(spark, sf)
    return rounded(fr.left_hold_pad(scores, h, 5), "score")


@query("min_fill_pad", MEANS + " SELECT h.series_id, h.idx, round(coalesce(sc.score, (SELECT min(score) FROM sc)), 6) AS score FROM ts_h h LEFT JOIN sc ON sc.idx = h.idx - 2")
def min_fill_pad(spark: SparkSession, sf: str) -> DataFrame:
    scores, h = window_means(spark, sf)
    return rounded(fr.min_fill_pad(scores, h, 5), "score")


@query("pad_by_edge", MEANS + " SELECT h.series_id, h.idx, round(sc.score, 6) AS score FROM ts_h h, n JOIN sc ON sc.idx = least(greatest(h.idx - 3, 0), n.last)")
def pad_by_edge(spark: SparkSession, sf: str) -> DataFrame:
    scores, h = window_means(spark, sf)
    return rounded(fr.pad_by_edge(scores, h, 3), "score")


@query("reverse_windowing", MEANS + " SELECT h.series_id, h.idx, round(avg(sc.score), 6) AS score FROM ts_h h JOIN sc ON h.idx BETWEEN sc.idx AND sc.idx + 4 GROUP BY 1, 2")
def reverse_windowing(spark: SparkSession, sf: str) -> DataFrame:
    scores, h = window_means(spark, sf)
    return rounded(fr.reverse_windowing(scores, h, 5), "score")


@query("coverage_mean", MEANS + " SELECT h.series_id, h.idx, round(avg(sc.score), 6) AS score FROM ts_h h JOIN sc ON sc.idx % 3 = 0 AND h.idx BETWEEN sc.idx AND sc.idx + 4 GROUP BY 1, 2")
def coverage_mean(spark: SparkSession, sf: str) -> DataFrame:
    scores, _ = window_means(spark, sf)
    return rounded(fr.coverage_mean(scores.filter("idx % 3 = 0"), 5), "score")


# Period

ACF = "x AS (SELECT idx, value - (SELECT avg(value) FROM ts_d WHERE idx < 20000) AS x FROM ts_d WHERE idx < 20000), ac AS (SELECT b.idx - a.idx AS lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM x) AS acf FROM x a JOIN x b ON b.idx BETWEEN a.idx AND a.idx + 400 GROUP BY 1)"


@query("acf_lags", ACF + " SELECT 'daily' AS series_id, lag::INTEGER AS lag, round(acf, 6) AS acf FROM ac")
def acf_lags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pe.acf(s.daily_series(spark, sf)), "acf")


@query("period_rank1", ACF + """, p AS (SELECT lag, acf, lag(acf) OVER (ORDER BY lag) AS a, lead(acf) OVER (ORDER BY lag) AS b FROM ac WHERE lag >= 3), t AS (SELECT max_by(lag, acf) AS top FROM p WHERE acf > a AND acf > b)
    SELECT 'daily' AS series_id, CASE WHEN top - 3 BETWEEN 3 AND 300 THEN top ELSE 125 END::INTEGER AS period FROM t""")
def period_rank1(spark: SparkSession, sf: str) -> DataFrame:
    return pe.period(s.daily_series(spark, sf))


@query("period_rank3", """ser AS (SELECT series_id, idx, value FROM ts_d WHERE idx < 20000 UNION ALL SELECT series_id, idx, value FROM ts_h WHERE idx < 20000), mn AS (SELECT series_id, avg(value) AS m FROM ser GROUP BY 1),
    x AS (SELECT ser.series_id, idx, value - m AS x FROM ser JOIN mn USING (series_id)), z AS (SELECT series_id, sum(x * x) AS z FROM x GROUP BY 1),
    ac AS (SELECT a.series_id, b.idx - a.idx AS lag, sum(a.x * b.x) / max(z) AS acf FROM x a JOIN x b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx AND a.idx + 400 JOIN z ON z.series_id = a.series_id GROUP BY 1, 2),
    p AS (SELECT *, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM ac WHERE lag >= 3 WINDOW w AS (PARTITION BY series_id ORDER BY lag)), t AS (SELECT series_id, lag, acf, row_number() OVER (PARTITION BY series_id ORDER BY lag) - 1 AS o FROM p WHERE acf > l AND acf > r),
    ls AS (SELECT series_id, list(struct_pack(o := o, lag := lag) ORDER BY acf DESC, o) AS ts FROM t GROUP BY 1), s2 AS (SELECT *, coalesce(list_filter(ts[2:], lambda e: e.o > ts[1].o)[1], ts[1]) AS sec FROM ls),
    s3 AS (SELECT *, ts[least(sec.o + 1, len(ts))] AS st FROM s2), s4 AS (SELECT *, coalesce(list_filter(ts[sec.o + 1:], lambda e: e.o > st.o)[1], ts[1]) AS thd FROM s3)
    SELECT series_id, (CASE WHEN sec.lag - 3 BETWEEN 3 AND 300 THEN sec.lag ELSE 125 END)::INTEGER AS second, (CASE WHEN thd.lag - 3 BETWEEN 3 AND 300 THEN thd.lag ELSE 125 END)::INTEGER AS third FROM s4""")
def period_rank3(spark: SparkSession, sf: str) -> DataFrame:
    series = s.daily_series(spark, sf).unionByName(s.hourly_series(spark, sf))
    return pe.period(series, 2).withColumnRenamed("period", "second").join(pe.period(series, 3).withColumnRenamed("period", "third"), "series_id")


@query("spectrum_periods", """f AS (SELECT unnest(range(1, (SELECT count(*) // 2 + 1 FROM ts_h))) AS freq), n AS (SELECT count(*) AS n FROM ts_h),
    p AS (SELECT freq, n, sqrt(pow(sum(value * cos(2 * pi() * ((idx * freq) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((idx * freq) % n) / n)), 2)) AS amplitude FROM ts_h, f, n GROUP BY 1, 2)
    SELECT 'hourly' AS series_id, row_number() OVER (ORDER BY amplitude DESC, freq)::INTEGER AS rank, freq::INTEGER AS freq, (n // freq)::INTEGER AS period, round(amplitude, 6) AS amplitude FROM p QUALIFY rank <= 5""")
def spectrum_periods(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pe.spectrum_periods(s.hourly_series(spark, sf), 5), "amplitude")


# Segments

RUNS = "hit AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM ts_u WHERE label = 1), runs AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY min(idx))::INTEGER AS seg_id, min(idx) AS s, max(idx) AS e FROM hit GROUP BY series_id, g), size AS (SELECT series_id, count(*) AS n, sum(label) AS p FROM ts_u GROUP BY 1)"


@query("segments", RUNS + " SELECT * FROM runs")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return sg.runs(s.event_series(spark, sf))


@query("merged_segments", RUNS + """, f AS (SELECT *, CASE WHEN lag(e) OVER w + 50 < s - 50 OR lag(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY s)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY s) AS seg FROM f) SELECT series_id, seg::INTEGER AS seg_id, greatest(min(s) - 50, 0) AS s, least(max(e) + 50, max(n) - 1) AS e FROM g JOIN size USING (series_id) GROUP BY series_id, seg""")
def merged_segments(spark: SparkSession, sf: str) -> DataFrame:
    return m.merged_runs(s.event_series(spark, sf), 100)


@query("soft_labels", RUNS + """, near AS (SELECT u.series_id, u.idx, sum(sqrt(1 - (CASE WHEN u.idx > e THEN u.idx - e ELSE s - u.idx END) / 20.0::DOUBLE)) AS more FROM ts_u u JOIN runs r ON u.series_id = r.series_id AND (u.idx BETWEEN e + 1 AND e + 10 OR u.idx BETWEEN s - 10 AND s - 1) GROUP BY 1, 2)
    SELECT series_id, idx, round(least(1, label + coalesce(more, 0)), 6) AS soft FROM ts_u LEFT JOIN near USING (series_id, idx)""")
def soft_labels(spark: SparkSession, sf: str) -> DataFrame:
    u = s.event_series(spark, sf)
    return rounded(sg.soft_labels(u, sg.runs(u), 20).select("series_id", "idx", "soft"), "soft")


@query("anomaly_attributes", RUNS + " SELECT series_id, count(*) AS num_anomaly, max((s = e)::INTEGER) AS point_anomaly, max((s < e)::INTEGER) AS seq_anomaly FROM runs GROUP BY 1")
def anomaly_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return sg.attributes(s.event_series(spark, sf))


# Measures: the score is how rare a value is in a histogram of ten bins.

HBOS = """zs AS (SELECT series_id, idx, label, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM ts_u WINDOW w AS (PARTITION BY series_id)),
    en AS (SELECT series_id, min(z) AS lo, max(z) AS hi, count(*) AS n, (max(z) - min(z)) / 10 AS width FROM zs GROUP BY 1),
    bins AS (SELECT zs.series_id, idx, label, n, width, least(floor((z - lo) / width), 9) AS lb, greatest(least(ceil((z - lo) / width) - 1, 9), 0) AS rb FROM zs JOIN en USING (series_id)),
    dens AS (SELECT series_id, lb, count(*)::DOUBLE / max(n) / max(width) AS density FROM bins GROUP BY 1, 2),
    sc AS (SELECT b.series_id, b.idx, b.label, -log2(coalesce(density, 0) + 0.1) AS score FROM bins b LEFT JOIN dens d ON d.series_id = b.series_id AND d.lb = b.rb)"""
#: As measures compare scores, both engines round them before.
SCORED = HBOS + ", x AS (SELECT u.series_id, u.idx, u.label, round(sc.score * 10 + u.value / 100, 4) AS score FROM sc JOIN ts_u u ON u.series_id = sc.series_id AND u.idx = sc.idx)"
STEPS = SCORED + """, g AS (SELECT series_id, score, count(*) AS n0, sum(label) AS p0 FROM x GROUP BY 1, 2),
    c AS (SELECT *, sum(n0) OVER w AS nc, sum(p0) OVER w AS pc, sum(n0) OVER t AS n, sum(p0) OVER t AS p FROM g WINDOW w AS (PARTITION BY series_id ORDER BY score DESC), t AS (PARTITION BY series_id))"""
GRID = SCORED + """, en2 AS (SELECT series_id, min(score) AS lo, max(score) AS hi, sum(label) AS p FROM x GROUP BY 1),
    th AS (SELECT series_id, k, p, CASE WHEN k = 99 THEN hi ELSE lo + k * ((hi - lo) / 99) END AS theta FROM en2, (SELECT unnest(range(100))::INTEGER AS k)),
    hit AS (SELECT series_id, idx, score, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM x WHERE label = 1),
    runs AS (SELECT series_id, g, min(idx) AS s, max(idx) AS e, max(score) AS top, max(CASE WHEN idx = 0 THEN score END) AS first FROM hit GROUP BY 1, 2),
    pts AS (SELECT t.series_id, t.k, sum(CASE WHEN x.score > theta THEN label ELSE 0 END) AS tp, sum(CASE WHEN x.score > theta THEN 1 ELSE 0 END) AS pp FROM th t JOIN x ON t.series_id = x.series_id GROUP BY 1, 2)"""


def hbos_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u = s.event_series(spark, sf)
    values = fr.zscore(u).select("series_id", "idx", F.lit(0).alias("lag"), "value")
    return d.hbos(values), u


def scored(spark: SparkSession, sf: str) -> DataFrame:
    scores, u = hbos_scores(spark, sf)
    return materialise(scores.join(u, ["series_id", "idx"]).select("series_id", "idx", "label", F.round(F.col("score") * 10 + F.col("value") / 100, 4).alias("score")))


@query("hbos_point", HBOS + " SELECT series_id, idx, round(score, 6) AS score FROM sc")
def hbos_point(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hbos_scores(spark, sf)[0], "score")


@query("auc_roc", STEPS + " SELECT series_id, round(sum((n0 - p0) * (pc - p0 / 2)) / max(p * (n - p)), 6) AS auc_roc FROM c GROUP BY 1")
def auc_roc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.roc_auc(scored(spark, sf)), "auc_roc")


@query("auc_pr", STEPS + " SELECT series_id, round(sum(p0::DOUBLE / p * pc / nc), 6) AS auc_pr FROM c WHERE p > 0 GROUP BY 1")
def auc_pr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.average_precision(scored(spark, sf)), "auc_pr")


@query("f1_oracle", STEPS + " SELECT series_id, round(max(2 * (pc::DOUBLE / nc) * (pc::DOUBLE / p) / (pc::DOUBLE / nc + pc::DOUBLE / p + 1e-5)), 6) AS f1 FROM c WHERE p > 0 GROUP BY 1")
def f1_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.best_f1(scored(spark, sf)), "f1")


PRED = SCORED + ", lim AS (SELECT series_id, avg(score) + stddev_pop(score) AS top FROM x GROUP BY 1), pr AS (SELECT x.*, (score > top)::INTEGER AS pred FROM x JOIN lim USING (series_id))"


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    x = scored(spark, sf)
    limit = x.groupBy("series_id").agg((F.avg("score") + F.stddev_pop("score")).alias("top"))
    return x.join(limit, "series_id").withColumn("pred", (F.col("score") > F.col("top")).cast("int")).drop("top")


@query("f1_pred", PRED + " SELECT series_id, round(coalesce(sum(label * pred) / nullif(sum(pred), 0), 0), 6) AS precision, round(sum(label * pred) / sum(label), 6) AS recall, round(2 * sum(label * pred) / (sum(pred) + sum(label)), 6) AS f1 FROM pr GROUP BY 1")
def f1_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.f1_of_predictions(predicted(spark, sf)), "precision", "recall", "f1")


@query("threshold_3sigma", SCORED + ", lim AS (SELECT series_id, avg(score) + 3 * stddev_pop(score) AS top FROM x GROUP BY 1) SELECT series_id, sum((score > top)::INTEGER)::BIGINT AS n FROM x JOIN lim USING (series_id) GROUP BY 1")
def threshold_3sigma(spark: SparkSession, sf: str) -> DataFrame:
    return m.three_sigma(scored(spark, sf)).groupBy("series_id").agg(F.sum("pred").cast("long").alias("n"))


@query("threshold_pct", SCORED + ", lim AS (SELECT series_id, quantile_cont(score, 0.9) AS top FROM x GROUP BY 1) SELECT series_id, sum((score > top)::INTEGER)::BIGINT AS n FROM x JOIN lim USING (series_id) GROUP BY 1")
def threshold_pct(spark: SparkSession, sf: str) -> DataFrame:
    return m.over_percentile(scored(spark, sf), 0.1).groupBy("series_id").agg(F.sum("pred").cast("long").alias("n"))


@query("precision_at_n", SCORED + """, r AS (SELECT series_id, score, label, row_number() OVER (PARTITION BY series_id ORDER BY score) - 1 AS i, count(*) OVER s AS n, sum(label) OVER s AS p FROM x WINDOW s AS (PARTITION BY series_id)),
    q AS (SELECT series_id, max(CASE WHEN i = floor(pos) THEN score END) AS a, max(CASE WHEN i = least(floor(pos) + 1, n - 1) THEN score END) AS b, max(pos - floor(pos)) AS part FROM (SELECT *, (n - 1) * (1 - p::DOUBLE / n) AS pos FROM r WHERE p > 0) GROUP BY 1)
    SELECT q.series_id, round(coalesce(avg(CASE WHEN score > a + (b - a) * part THEN label END), 0), 6) AS precision_at_n FROM q JOIN x USING (series_id) GROUP BY 1""")
def precision_at_n(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.precision_at_n(scored(spark, sf)), "precision_at_n")


@query("proba_linear", SCORED + " SELECT series_id, idx, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS probability FROM x WINDOW w AS (PARTITION BY series_id)")
def proba_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.probability(scored(spark, sf)).select("series_id", "idx", "probability"), "probability")


@query("proba_normal", SCORED + """, st AS (SELECT series_id, avg(score) AS mean, stddev_pop(score) * sqrt(2::DOUBLE) AS width FROM x GROUP BY 1), z AS (SELECT series_id, idx, (score - mean) / width AS z FROM x JOIN st USING (series_id)), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS t FROM z)
    SELECT series_id, idx, round(CASE WHEN z <= 0 THEN 0 ELSE least(1, greatest(0, 1 - ((((1.061405429::DOUBLE * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))) END, 6) AS probability FROM t""")
def proba_normal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.probability(scored(spark, sf), "normal").select("series_id", "idx", "probability"), "probability")


@query("score_rank", SCORED + " SELECT series_id, idx, count(*) OVER (PARTITION BY series_id ORDER BY score RANGE UNBOUNDED PRECEDING) AS rank FROM x")
def score_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ft.score_rank(scored(spark, sf)).select("series_id", "idx", "rank")


@query("top_scores", SCORED + " SELECT series_id, idx, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, idx)::INTEGER AS place FROM x QUALIFY place <= 20")
def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ft.top_n(scored(spark, sf), 20).select("series_id", "idx", "place")


@query("outcomes", PRED + " SELECT series_id, CASE WHEN label = 1 AND pred = 1 THEN 'tp' WHEN pred = 1 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS outcome, count(*) AS n FROM pr GROUP BY 1, 2")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return bench.outcomes(predicted(spark, sf)).groupBy("series_id", "outcome").agg(F.count("*").alias("n"))


@query("pa_f1", GRID + """, adj AS (SELECT t.series_id, t.k, sum(CASE WHEN top > theta THEN e - greatest(s, 1) + 1 ELSE 0 END) + sum(CASE WHEN first > theta THEN 1 ELSE 0 END) AS tp FROM th t JOIN runs r ON t.series_id = r.series_id GROUP BY 1, 2)
    SELECT series_id, round(max(CASE WHEN adj.tp + pp - pts.tp + p > 0 THEN 2 * adj.tp::DOUBLE / (adj.tp + pp - pts.tp + p) ELSE 0 END), 6) AS pa_f1 FROM th JOIN adj USING (series_id, k) JOIN pts USING (series_id, k) GROUP BY 1""")
def pa_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.adjusted_f1(scored(spark, sf)), "pa_f1")


@query("pa_latency", PRED + """, hit AS (SELECT series_id, idx, pred, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM pr WHERE label = 1), r AS (SELECT series_id, g, min(idx) AS s, min(CASE WHEN pred = 1 THEN idx END) AS h FROM hit GROUP BY 1, 2)
    SELECT series_id, round(coalesce(sum(h - s), 0) / (count(h) + 1e-4), 6) AS latency FROM r GROUP BY 1""")
def pa_latency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.adjustment_latency(predicted(spark, sf)), "latency")


@query("event_f1", GRID + """, ends AS (SELECT series_id, max(idx) AS last FROM x GROUP BY 1),
    ev AS (SELECT r.series_id, r.g, max(CASE WHEN h.idx < last OR e < last THEN h.score END) AS top FROM runs r JOIN hit h ON h.series_id = r.series_id AND h.g = r.g JOIN ends ON ends.series_id = r.series_id GROUP BY 1, 2),
    rec AS (SELECT t.series_id, t.k, sum(CASE WHEN top > theta THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r FROM th t JOIN ev ON t.series_id = ev.series_id GROUP BY 1, 2)
    SELECT series_id, round(max(2 * r * coalesce(tp::DOUBLE / nullif(pp, 0), 0) / (r + coalesce(tp::DOUBLE / nullif(pp, 0), 0) + 1e-15)), 6) AS event_f1 FROM rec JOIN pts USING (series_id, k) GROUP BY 1""")
def event_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.event_f1(scored(spark, sf)), "event_f1")


@query("range_f1", GRID + """, o AS (SELECT t.series_id, k, idx, idx - row_number() OVER (PARTITION BY t.series_id, k ORDER BY idx) AS g FROM th t JOIN x ON t.series_id = x.series_id AND x.score > theta),
    q AS (SELECT series_id, k, g, min(idx) AS qs, max(idx) AS qe FROM o GROUP BY 1, 2, 3),
    pairs AS (SELECT q.series_id, k, q.g AS q, r.g AS r, qs, qe, s, e, least(e, qe) - greatest(s, qs) + 1 AS shared FROM q JOIN runs r ON q.series_id = r.series_id AND qs <= e AND s <= qe),
    rr AS (SELECT series_id, k, sum(0.2 + 0.8 * part) AS r FROM (SELECT series_id, k, r, sum(shared)::DOUBLE / max(e - s + 1) / count(*) AS part FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2),
    pp2 AS (SELECT series_id, k, sum(part) AS p FROM (SELECT series_id, k, q, sum(shared)::DOUBLE / max(qe - qs + 1) / count(*) AS part FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2),
    nq AS (SELECT series_id, k, count(*) AS n FROM q GROUP BY 1, 2), nr AS (SELECT series_id, count(*) AS n FROM runs GROUP BY 1),
    f AS (SELECT th.series_id, th.k, coalesce(rr.r, 0) / nr.n AS r, coalesce(pp2.p / nq.n, 0) AS p FROM th JOIN nr ON nr.series_id = th.series_id LEFT JOIN nq ON nq.series_id = th.series_id AND nq.k = th.k LEFT JOIN rr ON rr.series_id = th.series_id AND rr.k = th.k LEFT JOIN pp2 ON pp2.series_id = th.series_id AND pp2.k = th.k)
    SELECT series_id, round(max(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END), 6) AS r_f1 FROM f GROUP BY 1""")
def range_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.range_f1(scored(spark, sf)), "r_f1")


VUS = """x AS (SELECT series_id, idx, label, round(abs(value - (SELECT avg(value) FROM ts_h)), 4) AS score FROM ts_h), n AS (SELECT count(*) AS n, sum(label) AS p FROM x),
    hit AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS g FROM x WHERE label = 1), runs AS (SELECT min(idx) AS s, max(idx) AS e FROM hit GROUP BY g), ws AS (SELECT unnest(range({lo}, {hi} + 1)) AS w),
    rk AS (SELECT score, row_number() OVER (ORDER BY score DESC, idx) - 1 AS place FROM x),
    th AS (SELECT k, score AS theta FROM (SELECT unnest(range(250)) AS k), n JOIN rk ON place = floor(k * (n - 1) / 249)::BIGINT),
    el AS (SELECT w, idx, score, label, least(1, label + coalesce((SELECT sum(sqrt(1 - (CASE WHEN x.idx > e THEN x.idx - e ELSE s - x.idx END)::DOUBLE / w)) FROM runs WHERE x.idx BETWEEN e + 1 AND e + w // 2 OR x.idx BETWEEN s - w // 2 AND s - 1), 0)) AS soft FROM x, ws),
    fl AS (SELECT w, s, e, CASE WHEN lag(e) OVER (PARTITION BY w ORDER BY s) + w // 2 >= s - w // 2 THEN 0 ELSE 1 END AS new FROM runs, ws),
    mr AS (SELECT w, seg, min(s) - w // 2 AS s, max(e) + w // 2 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY w ORDER BY s) AS seg FROM fl) GROUP BY w, seg),
    tops AS (SELECT w, seg, max(score) AS top FROM mr JOIN x ON idx BETWEEN s AND e GROUP BY 1, 2),
    ex AS (SELECT w, k, sum((top >= theta)::INTEGER)::DOUBLE / count(*) AS existence FROM tops, th GROUP BY 1, 2),
    ce AS (SELECT w, k, sum(CASE WHEN score >= theta THEN soft ELSE 0 END) AS tp, sum((score >= theta)::INTEGER) AS c, sum(CASE WHEN score >= theta AND label = 0 THEN soft ELSE 0 END) AS more FROM el, th GROUP BY 1, 2),
    cu AS (SELECT w, k, least(tp / (p + more / 2), 1) * existence AS tpr, (c - tp) / (n - (p + more / 2)) AS fpr, tp / c AS prec FROM ce JOIN ex USING (w, k), n),
    st AS (SELECT *, coalesce(lag(tpr) OVER o, 0) AS t0, coalesce(lag(fpr) OVER o, 0) AS f0 FROM cu WINDOW o AS (PARTITION BY w ORDER BY k)),
    ar AS (SELECT w, sum((fpr - f0) * (tpr + t0) / 2) + (1 - max_by(fpr, k)) * (1 + max_by(tpr, k)) / 2 AS roc, sum((tpr - t0) * prec) AS pr FROM st GROUP BY 1)
    SELECT 'hourly' AS series_id, round(avg(roc), 6) AS {a}, round(avg(pr), 6) AS {b} FROM ar"""


def deviations(spark: SparkSession, sf: str) -> DataFrame:
    h = s.hourly_series(spark, sf)
    mean = h.groupBy("series_id").agg(F.avg("value").alias("mean"))
    return materialise(h.join(mean, "series_id").select("series_id", "idx", "label", F.round(F.abs(F.col("value") - F.col("mean")), 4).alias("score")))


@query("vus", VUS.format(lo=0, hi=20, a="vus_roc", b="vus_pr"))
def vus(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.volume_under_surface(deviations(spark, sf), 20), "vus_roc", "vus_pr")


@query("range_auc", VUS.format(lo=24, hi=24, a="range_auc_roc", b="range_auc_pr"))
def range_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.range_auc(deviations(spark, sf), 24), "range_auc_roc", "range_auc_pr")


@query("range_auc_share")
def range_auc_share(spark: SparkSession, sf: str) -> DataFrame:
    """Areas with buffers of a fifth of each run; tests hold them against a plain version."""
    return rounded(m.range_auc_share(deviations(spark, sf)), "range_auc_roc", "range_auc_pr")


PRUNS = PRED + """, hit AS (SELECT series_id, idx, pred, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM pr WHERE label = 1), runs AS (SELECT series_id, g, min(idx) AS s, max(idx) AS e, max(pred) AS top, max(CASE WHEN idx = 0 THEN pred END) AS first FROM hit GROUP BY 1, 2),
    qs AS (SELECT series_id, g, min(idx) AS qs, max(idx) AS qe FROM (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM pr WHERE pred = 1) GROUP BY 1, 2),
    t AS (SELECT series_id, sum(label) AS p, sum(pred) AS pp, sum(label * pred) AS tp, max(idx) AS last FROM pr GROUP BY 1)"""


@query("pa_f1_pred", PRUNS + """, a AS (SELECT series_id, sum(CASE WHEN top = 1 THEN e - greatest(s, 1) + 1 ELSE 0 END) + sum(coalesce(first, 0)) AS hits FROM runs GROUP BY 1)
    SELECT series_id, round(2 * hits::DOUBLE / (hits + pp - tp + p), 6) AS pa_f1 FROM a JOIN t USING (series_id)""")
def pa_f1_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.adjusted_of_predictions(predicted(spark, sf)), "pa_f1")


@query("event_f1_pred", PRUNS + """, f AS (SELECT series_id, count(DISTINCT g) AS hits FROM hit JOIN t USING (series_id) WHERE pred = 1 AND idx < last GROUP BY 1), n AS (SELECT series_id, count(*) AS events FROM runs GROUP BY 1),
    rp AS (SELECT n.series_id, coalesce(hits, 0)::DOUBLE / events AS r, coalesce(tp::DOUBLE / nullif(pp, 0), 0) AS p FROM n JOIN t USING (series_id) LEFT JOIN f ON f.series_id = n.series_id)
    SELECT series_id, round(2 * r * p / (r + p + 1e-15), 6) AS event_f1 FROM rp""")
def event_f1_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.event_of_predictions(predicted(spark, sf)), "event_f1")


RANGE_PRED = PRUNS + """, pairs AS (SELECT q.series_id, q.g AS q, r.g AS r, qs, qe, s, e, greatest(s, qs) AS lo, least(e, qe) AS hi FROM qs q JOIN runs r ON q.series_id = r.series_id AND qs <= e AND s <= qe),
    a AS (SELECT series_id, count(*) AS met, sum(part) AS over, sum(0.2 + 0.8 * part) AS r FROM (SELECT series_id, r, {truth} / count(*) AS part FROM pairs GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT series_id, sum(part) AS p FROM (SELECT series_id, q, {found} / count(*) AS part FROM pairs GROUP BY 1, 2) GROUP BY 1),
    nr AS (SELECT series_id, count(*) AS nr FROM runs GROUP BY 1), nq AS (SELECT series_id, count(*) AS nq FROM qs GROUP BY 1),
    f AS (SELECT nr.series_id, coalesce(a.r, 0) / nr AS r, coalesce(met, 0)::DOUBLE / nr AS existence, coalesce(over, 0) / nr AS overlap, coalesce(b.p / nq, 0) AS p FROM nr LEFT JOIN nq ON nq.series_id = nr.series_id LEFT JOIN a ON a.series_id = nr.series_id LEFT JOIN b ON b.series_id = nr.series_id)
    SELECT series_id, round(r, 6) AS range_recall, round(existence, 6) AS existence, round(overlap, 6) AS overlap, round(p, 6) AS range_precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS r_f1 FROM f"""
RANGE_FIGURES = ("range_recall", "existence", "overlap", "range_precision", "r_f1")


@query("range_pred", RANGE_PRED.format(truth="sum(hi - lo + 1)::DOUBLE / max(e - s + 1)", found="sum(hi - lo + 1)::DOUBLE / max(qe - qs + 1)"))
def range_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.range_of_predictions(predicted(spark, sf)), *RANGE_FIGURES)


@query("range_pred_back", RANGE_PRED.format(truth="sum((hi - lo + 1) * (hi + lo))::DOUBLE / max((e - s + 1) * (e + s))", found="sum((hi - lo + 1) * (hi + lo))::DOUBLE / max((qe - qs + 1) * (qe + qs))"))
def range_pred_back(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.range_of_predictions(predicted(spark, sf), bias="back"), *RANGE_FIGURES)


@query("vus_pred", PRUNS + """, sd AS (SELECT series_id, w, d, unnest([s - d, e + d]) AS idx, sqrt(1 - d::DOUBLE / w) AS soft FROM runs, (SELECT w, unnest(range(1, w // 2 + 1)) AS d FROM (SELECT unnest(range(2, 21)) AS w))),
    so AS (SELECT series_id, w, idx, least(1, sum(soft)) AS soft FROM sd GROUP BY 1, 2, 3), mo AS (SELECT so.series_id, w, sum(soft) AS more FROM so JOIN pr ON pr.series_id = so.series_id AND pr.idx = so.idx WHERE label = 0 AND pred = 1 GROUP BY 1, 2),
    ce AS (SELECT t.series_id, least(1, (tp + coalesce(more, 0)) / (p + coalesce(more, 0) / 2)) AS r, coalesce((tp + coalesce(more, 0)) / nullif(pp, 0), 0) AS p FROM t JOIN (SELECT unnest(range(0, 21)) AS w) ws ON p > 0 LEFT JOIN mo ON mo.series_id = t.series_id AND mo.w = ws.w)
    SELECT series_id, round(avg(r), 6) AS vus_recall, round(avg(p), 6) AS vus_precision, round(avg(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END), 6) AS vus_f FROM ce GROUP BY 1""")
def vus_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.volume_of_predictions(predicted(spark, sf), 20), "vus_recall", "vus_precision", "vus_f")


@query("evaluate_pred")
def evaluate_pred(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.evaluate_predictions(predicted(spark, sf), 20), "f1", "pa_f1", "event_f1", "r_f1", "affiliation_f", "vus_recall", "vus_precision", "vus_f")


@query("evaluate_3sigma")
def evaluate_3sigma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.evaluate_one_threshold(scored(spark, sf)), "auc_roc", "precision", "recall", "f1", "pa_f1", "precision_at_n", *RANGE_FIGURES)


@query("confidence", SCORED + """, r AS (SELECT series_id, idx, score, count(*) OVER (PARTITION BY series_id ORDER BY score RANGE UNBOUNDED PRECEDING) AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM x),
    lim AS (SELECT series_id, quantile_cont(score, 0.9) AS top FROM x GROUP BY 1), ch AS (SELECT DISTINCT rank, n, (1 + rank)::DOUBLE / (2 + n) AS p FROM r),
    k AS (SELECT rank, n, p, unnest(range(n - floor(n * 0.1::DOUBLE)::BIGINT + 1, n + 1)) AS k FROM ch), t AS (SELECT rank, n, least(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))), 1) AS c FROM k GROUP BY 1, 2)
    SELECT series_id, idx, round(CASE WHEN score > top THEN coalesce(c, 0) ELSE 1 - coalesce(c, 0) END, 6) AS confidence FROM r JOIN lim USING (series_id) LEFT JOIN t USING (rank, n)""")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.confidence(scored(spark, sf)).select("series_id", "idx", "confidence"), "confidence")


@query("affiliation")
def affiliation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.affiliation(scored(spark, sf)), "affiliation_f")


@query("evaluate")
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.evaluate(deviations(spark, sf), 20), *bench.MEASURES)


# Detectors

ENDS = "SELECT series_id, idx, round(sum(score), 6) AS score FROM {t} GROUP BY 1, 2"


@query("copod", ROWS + """, t AS (SELECT series_id, idx, lag, -ln(cume_dist() OVER (PARTITION BY lag ORDER BY round(value, 9))) AS l, -ln(cume_dist() OVER (PARTITION BY lag ORDER BY round(value, 9) DESC)) AS r, sign(skewness(value) OVER (PARTITION BY lag)) AS side FROM z)
    SELECT series_id, idx, round(sum(greatest(CASE WHEN side > 0 THEN r WHEN side < 0 THEN l ELSE l + r END, (l + r) / 2)), 6) AS score FROM t GROUP BY 1, 2""")
def copod(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.zscore_rows(s.shipment_series(spark, sf), "features")
    return rounded(d.copod(d.channel_values(rows).withColumn("value", F.round("value", 9))), "score")


W24 = """w AS (SELECT a.idx, b.idx - a.idx AS lag, b.value FROM ts_h a JOIN ts_h b ON b.idx BETWEEN a.idx AND a.idx + 23 WHERE a.idx <= (SELECT max(idx) - 23 FROM ts_h)),
    zw AS (SELECT idx, lag, (value - avg(value) OVER l) / stddev_pop(value) OVER l AS z FROM w WINDOW l AS (PARTITION BY lag))"""
EDGE24 = " SELECT 'hourly' AS series_id, h.idx, round(sc.score, 6) AS score FROM ts_h h, (SELECT max(idx) AS last FROM sc) n JOIN sc ON sc.idx = least(greatest(h.idx - 12, 0), last)"


@query("sub_hbos", W24 + """, en AS (SELECT lag, min(z) AS lo, max(z) AS hi, count(*) AS n, (max(z) - min(z)) / 10 AS width FROM zw GROUP BY 1),
    bins AS (SELECT idx, lag, n, width, least(floor((z - lo) / width), 9) AS lb, greatest(least(ceil((z - lo) / width) - 1, 9), 0) AS rb FROM zw JOIN en USING (lag)), dens AS (SELECT lag, lb, count(*)::DOUBLE / max(n) / max(width) AS density FROM bins GROUP BY 1, 2),
    sc AS (SELECT b.idx, sum(-log2(coalesce(density, 0) + 0.1)) AS score FROM bins b LEFT JOIN dens d ON d.lag = b.lag AND d.lb = b.rb GROUP BY 1)""" + EDGE24)
def sub_hbos(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.sub_hbos(s.hourly_series(spark, sf), 24), "score")


PAIRS = "pairs AS (SELECT a.idx, b.idx AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM vec a JOIN vec b ON a.idx <> b.idx), near AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY dist, other) AS rank FROM pairs QUALIFY rank <= 10)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return s.point_set(spark, sf).select("series_id", "idx", F.col("features").alias("v"))


@query("knn", PAIRS + " SELECT 'vec' AS series_id, idx, round(max(dist), 6) AS score FROM near GROUP BY idx")
def knn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.knn(vectors(spark, sf), 10), "score")


@query("knn_mean", PAIRS + " SELECT 'vec' AS series_id, idx, round(avg(dist), 6) AS score FROM near GROUP BY idx")
def knn_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.knn(vectors(spark, sf), 10, "mean"), "score")


@query("lof", PAIRS + """, kd AS (SELECT idx AS other, max(dist) AS kd FROM near GROUP BY 1), lrd AS (SELECT idx, 1 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM near JOIN kd USING (other) GROUP BY 1)
    SELECT 'vec' AS series_id, near.idx, round(avg(b.lrd) / max(a.lrd), 6) AS score FROM near JOIN lrd a ON a.idx = near.idx JOIN lrd b ON b.idx = near.other GROUP BY near.idx""")
def lof(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.lof(vectors(spark, sf), 10), "score")


@query("cof", PAIRS + """, btw AS (SELECT n.idx, n.rank AS h, n.dist, min(p.dist) AS nearest FROM near n LEFT JOIN near e ON e.idx = n.idx AND e.rank < n.rank LEFT JOIN pairs p ON p.idx = n.other AND p.other = e.other GROUP BY 1, 2, 3),
    ac AS (SELECT idx, sum(2 * (11 - h)::DOUBLE / 110 * least(dist, coalesce(nearest, dist))) AS ac FROM btw GROUP BY 1)
    SELECT 'vec' AS series_id, near.idx, round(10 * max(a.ac) / sum(b.ac), 6) AS score FROM near JOIN ac a ON a.idx = near.idx JOIN ac b ON b.idx = near.other GROUP BY near.idx""")
def cof(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.cof(vectors(spark, sf), 10), "score")


PROFILE = """w AS (SELECT a.idx, b.idx - a.idx AS lag, b.value FROM ts_h a JOIN ts_h b ON b.idx BETWEEN a.idx AND a.idx + 23 WHERE a.idx <= (SELECT max(idx) - 23 FROM ts_h)),
    z AS (SELECT idx, list((value - m) / s ORDER BY lag) AS v FROM w JOIN (SELECT idx, avg(value) AS m, stddev_pop(value) AS s FROM w GROUP BY 1) USING (idx) GROUP BY 1),
    pr AS (SELECT a.idx, b.idx AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM z a JOIN z b ON abs(a.idx - b.idx) > 6)"""


@query("matrix_profile", PROFILE + ", mp AS (SELECT idx, min(dist) AS score FROM pr GROUP BY 1) SELECT 'hourly' AS series_id, h.idx, round(coalesce(score, (SELECT min(score) FROM mp)), 6) AS score FROM ts_h h LEFT JOIN mp ON mp.idx = h.idx - 12")
def matrix_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.matrix_profile(s.hourly_series(spark, sf), 24), "score")


@query("left_profile", PROFILE + ", mp AS (SELECT idx, min(dist) AS score FROM pr WHERE other < idx GROUP BY 1) SELECT 'hourly' AS series_id, h.idx, round(CASE WHEN h.idx < 100 THEN 0 ELSE coalesce(score, 0) END, 6) AS score FROM ts_h h LEFT JOIN mp ON mp.idx = h.idx - 23")
def left_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.left_profile(s.hourly_series(spark, sf), 24, 100), "score")


@query("fft_regions", """z AS (SELECT idx, (value - (SELECT avg(value) FROM ts_h)) / (SELECT stddev_pop(value) FROM ts_h) AS z FROM ts_h),
    o AS (SELECT idx, CASE WHEN idx < 5 THEN 0 ELSE abs(z) END AS so, z - avg(z) OVER (ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS off FROM z), l AS (SELECT * FROM o WHERE so > (SELECT avg(so) FROM o)),
    q AS (SELECT idx, (off - (SELECT avg(off) FROM l)) / ((SELECT stddev_pop(off) FROM l) + 1e-6) AS q FROM l), f AS (SELECT *, CASE WHEN idx - lag(idx) OVER (ORDER BY idx) <= 10 THEN 0 ELSE 1 END AS new FROM q WHERE abs(q) > 0.6),
    g AS (SELECT *, sum(new) OVER (ORDER BY idx) AS r FROM f), rg AS (SELECT min(idx) AS s, max(idx) AS e, avg(abs(q)) AS score FROM g GROUP BY r HAVING count(*) > 1)
    SELECT 'hourly' AS series_id, h.idx, round(coalesce(score, 0), 6) AS score FROM ts_h h LEFT JOIN rg ON h.idx BETWEEN s AND e""")
def fft_regions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.fft_regions(s.hourly_series(spark, sf)), "score")


@query("poly_line", """x AS (SELECT idx, (value - (SELECT min(value) FROM ts_h)) / (SELECT max(value) - min(value) FROM ts_h) AS y FROM ts_h), n AS (SELECT count(*) AS n, least(200, count(*)) AS hood, count(*) // 24 AS b1, ceil(least(500, floor(count(*) * 0.1)) / 24)::BIGINT AS b0 FROM x),
    b AS (SELECT n, hood, unnest(range(b0, b1 + 1)) * 24 AS pos FROM n), c AS (SELECT *, CASE WHEN pos + hood // 2 < n AND pos - hood // 2 > 0 THEN 1 WHEN pos + hood // 2 >= n THEN 2 ELSE 3 END AS kind FROM b WHERE pos < n),
    r AS (SELECT pos, n, CASE kind WHEN 1 THEN pos - hood // 2 WHEN 2 THEN n - hood ELSE 0 END AS lo, CASE kind WHEN 1 THEN pos + hood // 2 WHEN 2 THEN n ELSE hood END AS hi FROM c),
    l AS (SELECT pos, max(n) AS n, regr_slope(y, idx) AS a, regr_intercept(y, idx) AS b FROM r JOIN x ON idx >= lo AND idx < hi AND NOT idx BETWEEN pos AND pos + 23 GROUP BY 1),
    sz AS (SELECT pos, sqrt(sum(pow(y - (a * (CASE WHEN pos + 24 <= n THEN pos + (idx - pos) * (24.0::DOUBLE / 23) ELSE idx END) + b), 2)) / count(*)) AS score FROM l JOIN x ON idx BETWEEN pos AND pos + 23 GROUP BY 1)
    SELECT 'hourly' AS series_id, x.idx, round(coalesce(score, 0), 6) AS score FROM x LEFT JOIN sz ON x.idx BETWEEN pos AND pos + 23""")
def poly_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.poly_blocks(s.hourly_series(spark, sf), 24, 200), "score")


SUB = W24 + ", vw AS (SELECT idx, list(z ORDER BY lag) AS v FROM zw GROUP BY 1), " + PAIRS.replace("vec a", "vw a").replace("vec b", "vw b")
#: SQL of the detectors that SQL can express.
DETECTOR_SQL = {
    "detect_seasonal": "SELECT h.series_id, 'Seasonal' AS detector, h.idx, round(coalesce(pow(h.value - b.value, 2), 0), 6) AS score, NULL::VARCHAR AS error FROM ts_h h LEFT JOIN ts_h b ON b.idx = h.idx - 24",
    "events_seasonal": "SELECT u.series_id, 'Seasonal' AS detector, u.idx, round(coalesce(pow(u.value - b.value, 2), 0), 6) AS score, NULL::VARCHAR AS error FROM ts_u u LEFT JOIN ts_u b ON b.series_id = u.series_id AND b.idx = u.idx - 24",
    "detect_hbos": ROWS + """, en AS (SELECT lag, min(value) AS lo, max(value) AS hi, count(*) AS n, (max(value) - min(value)) / 10 AS width FROM z GROUP BY 1),
        bins AS (SELECT idx, lag, n, width, least(floor((value - lo) / width), 9) AS lb, greatest(least(ceil((value - lo) / width) - 1, 9), 0) AS rb FROM z JOIN en USING (lag)), dens AS (SELECT lag, lb, count(*)::DOUBLE / max(n) / max(width) AS density FROM bins GROUP BY 1, 2)
        SELECT 'shipments' AS series_id, 'HBOS' AS detector, b.idx, round(sum(-log2(coalesce(density, 0) + 0.1)), 6) AS score, NULL::VARCHAR AS error FROM bins b LEFT JOIN dens d ON d.lag = b.lag AND d.lb = b.rb GROUP BY b.idx""",
    "detect_sub_lof": SUB.replace("<= 10", "<= 30") + """, kd AS (SELECT idx AS other, max(dist) AS kd FROM near GROUP BY 1), lrd AS (SELECT idx, 1 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM near JOIN kd USING (other) GROUP BY 1),
        sc AS (SELECT near.idx, avg(b.lrd) / max(a.lrd) AS score FROM near JOIN lrd a ON a.idx = near.idx JOIN lrd b ON b.idx = near.other GROUP BY near.idx)""" + EDGE24.replace("'hourly' AS series_id, h.idx,", "'hourly' AS series_id, 'Sub_LOF' AS detector, h.idx,").replace("AS score FROM ts_h", "AS score, NULL::VARCHAR AS error FROM ts_h"),
    "detect_sub_knn": SUB + ", sc AS (SELECT idx, max(dist) AS score FROM near GROUP BY 1)" + EDGE24.replace("'hourly' AS series_id, h.idx,", "'hourly' AS series_id, 'Sub_KNN' AS detector, h.idx,").replace("AS score FROM ts_h", "AS score, NULL::VARCHAR AS error FROM ts_h"),
}


def _detector(name: str, key: str, build: Callable[[SparkSession, str], DataFrame], **params) -> None:
    query(key, DETECTOR_SQL.get(key))(lambda spark, sf: detect(build(spark, sf), name, **params).select("series_id", "detector", "idx", F.round("score", 6).alias("score"), "error"))


for _name, _params in {
    "IForest": {"width": 24}, "Sub_IForest": {"width": 24}, "PCA": {"width": 24}, "Sub_PCA": {"width": 24}, "SR": {}, "POLY": {"width": 24}, "KShapeAD": {}, "SAND": {}, "KMeansAD": {"width": 24}, "KMeansAD_U": {"width": 24},
    "AutoEncoder": {"width": 24}, "FITS": {"width": 24}, "DetrendedMean": {}, "Seasonal": {}, "LinearForecast": {"width": 24}, "Sub_OCSVM": {"width": 24}, "Sub_MCD": {}, "Sub_KNN": {"width": 24}, "Sub_LOF": {"width": 24},
}.items():
    _detector(_name, f"detect_{_name.lower()}", s.hourly_series, **_params)
for _name in ("HBOS", "OCSVM", "MCD", "CBLOF", "EIF", "RobustPCA"):
    _detector(_name, f"detect_{_name.lower()}", s.shipment_series)
#: Detectors whose cost is linear in the points also score the events, which grow with the tables.
for _name, _params in {"IForest": {"width": 16}, "PCA": {"width": 16}, "KMeansAD": {"width": 16}, "Sub_MCD": {}, "LinearForecast": {"width": 16}, "FITS": {"width": 16}, "Seasonal": {}, "POLY": {"width": 64}}.items():
    _detector(_name, f"events_{_name.lower()}", s.event_series, **_params)


# Benchmark: nations as detectors, priorities as series, mean prices as measures.

RESULTS = "res AS (SELECT o_orderpriority AS series_id, n_name AS detector, 'price' AS measure, round(avg(o_totalprice), 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
RANKS = RESULTS + ", rk AS (SELECT *, rank() OVER (PARTITION BY measure, series_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY measure, series_id, value) - 1) / 2 AS rank FROM res)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("n_name").alias("detector")).agg(F.round(F.avg("o_totalprice"), 6).alias("value")).withColumn("measure", F.lit("price"))


@query("leaderboard", RESULTS + ", mn AS (SELECT measure, detector, avg(value) AS mean FROM res GROUP BY 1, 2) SELECT measure, detector, round(mean, 4) AS mean, (rank() OVER (ORDER BY mean DESC))::DOUBLE AS rank FROM mn")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return bench.leaderboard(results(spark, sf)).withColumn("mean", F.round("mean", 4))


@query("leaderboard_quartiles", RESULTS + " SELECT measure, detector, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(avg(value), 4) AS mean FROM res GROUP BY 1, 2")
def leaderboard_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return bench.quartiles(results(spark, sf)).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "mean")})


@query("average_ranks", RANKS + " SELECT measure, detector, round(avg(rank), 6) AS average_rank, count(*) AS n_series FROM rk GROUP BY 1, 2")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bench.average_ranks(results(spark, sf)), "average_rank")


@query("friedman", RANKS + """, sm AS (SELECT detector, sum(rank) AS s FROM rk GROUP BY 1), sz AS (SELECT count(DISTINCT series_id) AS n, count(DISTINCT detector) AS k FROM rk), ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY series_id, value))
    SELECT 'price' AS measure, n, k, round((12.0::DOUBLE / (n * k * (k + 1)) * (SELECT sum(s * s) FROM sm) - 3 * n * (k + 1)) / (1 - ties::DOUBLE / (n * k * (k * k - 1))), 6) AS statistic FROM sz, ti""")
def friedman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bench.friedman(results(spark, sf)).drop("p"), "statistic")


@query("cliques", "RECURSIVE" + RESULTS + """, pa AS (SELECT x.detector AS a, y.detector AS b FROM res x JOIN res y ON x.series_id = y.series_id AND x.detector < y.detector GROUP BY 1, 2 HAVING sum((x.value > y.value)::INTEGER) BETWEEN 2 AND count(*) - 2),
    ed AS (SELECT a, b FROM pa UNION ALL SELECT b, a FROM pa),
    cl AS (SELECT [detector] AS m, detector AS z FROM (SELECT DISTINCT detector FROM res) UNION ALL SELECT list_append(m, e.b), e.b FROM cl JOIN ed e ON e.a = cl.z AND e.b > cl.z WHERE (SELECT count(*) FROM ed f WHERE f.b = e.b AND list_contains(cl.m, f.a)) = len(cl.m))
    SELECT 'price' AS measure, array_to_string(m, ', ') AS clique, len(m)::INTEGER AS size FROM cl WHERE len(m) > 1 AND NOT EXISTS (SELECT 1 FROM ed g WHERE list_contains(cl.m, g.a) GROUP BY g.b HAVING count(*) = len(cl.m))""")
def cliques(spark: SparkSession, sf: str) -> DataFrame:
    """Largest groups of detectors of which no two differ by more than chance: each is better in two cases at least."""
    r = results(spark, sf)
    x, y = (r.select("series_id", "measure", F.col("detector").alias(n), F.col("value").alias(f"v{n}")) for n in "ab")
    pairs = x.join(y, ["series_id", "measure"]).filter("a < b").groupBy("measure", "a", "b").agg(F.sum((F.col("va") > F.col("vb")).cast("int")).alias("wins"), F.count("*").alias("n"))
    found = bench.clique_table(pairs.withColumn("alike", F.col("wins").between(2, F.col("n") - 2)))
    return found.select("measure", F.array_join("clique", ", ").alias("clique"), F.size("clique").alias("size"))


@query("nemenyi")
def nemenyi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bench.nemenyi(results(spark, sf)), "difference", "q", "p")


@query("wide_results", RESULTS + " SELECT detector, max(CASE WHEN series_id = '1-URGENT' THEN value END) AS urgent, max(CASE WHEN series_id = '5-LOW' THEN value END) AS low FROM res GROUP BY 1")
def wide_results(spark: SparkSession, sf: str) -> DataFrame:
    wide = results(spark, sf).groupBy("detector").pivot("series_id", ["1-URGENT", "5-LOW"]).agg(F.first("value"))
    return wide.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("long_results", RESULTS + " SELECT detector, CASE series_id WHEN '1-URGENT' THEN 'urgent' ELSE 'low' END AS kind, value FROM res WHERE series_id IN ('1-URGENT', '5-LOW')")
def long_results(spark: SparkSession, sf: str) -> DataFrame:
    return wide_results(spark, sf).unpivot("detector", ["urgent", "low"], "kind", "value").filter("value IS NOT NULL")


@query("best_params", RESULTS + ", mn AS (SELECT detector, series_id AS params, value AS mean FROM res) SELECT detector, max_by(params, mean) AS params, round(max(mean), 4) AS mean FROM mn GROUP BY 1")
def best_params(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).withColumnRenamed("series_id", "params").withColumnRenamed("value", "vus_pr")
    return bench.best_params(r).withColumn("mean", F.round("mean", 4))


@query("benchmark_run")
def benchmark_run(spark: SparkSession, sf: str) -> DataFrame:
    jobs = [("Sub_HBOS", {"width": 24}), ("MatrixProfile", {"width": 24}), ("SR", {}), ("Sub_PCA", {"width": 24})]
    return rounded(bench.run_benchmark(s.hourly_series(spark, sf), jobs, 10), *bench.MEASURES)


# Features


@query("window_moments", WINDOWS + ", st AS (SELECT series_id, idx, avg(value) AS mean, var_pop(value) AS variance, max(value) AS greatest, min(value) AS least FROM w GROUP BY 1, 2) SELECT series_id, idx, round(mean, 6) AS mean, round(variance, 6) AS variance, round(greatest, 6) AS greatest, round(least, 6) AS least FROM st")
def window_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.window_features(s.hourly_series(spark, sf), 5).select("series_id", "idx", "mean", "variance", "greatest", "least"), "mean", "variance", "greatest", "least")


@query("window_autocorrelation", WINDOWS + ", st AS (SELECT idx, avg(value) AS m, var_pop(value) AS v FROM w GROUP BY 1) SELECT 'hourly' AS series_id, a.idx, round(sum((a.value - m) * (b.value - m)) / 4 / max(v), 6) AS autocorrelation FROM w a JOIN w b ON a.idx = b.idx AND b.lag = a.lag + 1 JOIN st ON st.idx = a.idx GROUP BY a.idx")
def window_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.window_features(s.hourly_series(spark, sf), 5).select("series_id", "idx", "autocorrelation"), "autocorrelation")


@query("ecdf", "SELECT series_id, idx, lag, round(cume_dist() OVER (PARTITION BY lag ORDER BY round(value, 9)), 6) AS ecdf FROM lags_m")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.ecdf(d.channel_values(s.shipment_series(spark, sf)).withColumn("value", F.round("value", 9))), "ecdf")


@query("column_entropy", """en AS (SELECT lag, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT lag, round(value, 9) AS v FROM lags_m) GROUP BY 1), b AS (SELECT lag, least(floor((round(value, 9) - lo) / (hi - lo) * 10), 9) AS bin, max(n) AS n, count(*) AS c FROM lags_m JOIN en USING (lag) GROUP BY 1, 2)
    SELECT 'shipments' AS series_id, lag, round(-sum(c::DOUBLE / n * log2(c::DOUBLE / n)), 6) AS entropy, round(1 + sum(c::DOUBLE / n * log2(c::DOUBLE / n)) / log2(10), 6) AS weight FROM b GROUP BY lag""")
def column_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.column_entropy(d.channel_values(s.shipment_series(spark, sf)).withColumn("value", F.round("value", 9))), "entropy", "weight")


@query("pearson", "SELECT a.series_id, a.lag AS a, b.lag AS b, round(corr(a.value, b.value), 6) AS pearson FROM lags_m a JOIN lags_m b ON a.idx = b.idx AND a.lag < b.lag GROUP BY 1, 2, 3")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.correlations(d.channel_values(s.shipment_series(spark, sf))), "pearson")


@query("array_distances", WINDOWS + ", pr AS (SELECT a.idx, sum(abs(a.value - b.value)) AS l1, sum(pow(a.value - b.value, 2)) AS l2 FROM w a JOIN w b ON b.idx = a.idx + 5 AND a.lag = b.lag GROUP BY 1) SELECT 'hourly' AS series_id, idx, round(l1 / 5, 6) AS manhattan, round(sqrt(l2) / 5, 6) AS euclidean, round(sqrt(l2) / 5 * sqrt(5), 6) AS fourier FROM pr")
def array_distances(spark: SparkSession, sf: str) -> DataFrame:
    w = fr.windows(s.hourly_series(spark, sf), 5)
    later = w.select("series_id", (F.col("idx") - 5).alias("idx"), F.col("window").alias("next"))
    a, b = F.col("window"), F.col("next")
    return rounded(w.join(later, ["series_id", "idx"]).select("series_id", "idx", arrays.lp_distance(a, b, 1).alias("manhattan"), arrays.lp_distance(a, b).alias("euclidean"), arrays.fourier_distance(a, b).alias("fourier")), "manhattan", "euclidean", "fourier")


@query("window_autoregression", WINDOWS.replace("+ 4", "+ 11").replace("- 4", "- 11") + """, l AS (SELECT a.idx, regr_slope(b.value, a.value) AS slope FROM w a JOIN w b ON b.idx = a.idx AND b.lag = a.lag + 1 GROUP BY 1) SELECT 'hourly' AS series_id, idx, round(slope, 6) AS autoregression FROM l""")
def window_autoregression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.sequence_statistics(s.hourly_series(spark, sf), 12).select("series_id", "idx", "autoregression"), "autoregression")


@query("window_entropy_hurst")
def window_entropy_hurst(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.sequence_statistics(s.hourly_series(spark, sf), 64).select("series_id", "idx", "entropy", "hurst"), "entropy", "hurst")


def window_pairs(spark: SparkSession, sf: str, change: Callable[[DataFrame], DataFrame] = lambda h: h, width: int = 12) -> DataFrame:
    """Each window of 12 hours beside that of the day after."""
    w = fr.windows(change(s.hourly_series(spark, sf)), width)
    later = w.select("series_id", (F.col("idx") - 24).alias("idx"), F.col("window").alias("b"))
    return w.withColumnRenamed("window", "a").join(later, ["series_id", "idx"])


PAIRS = """l AS (SELECT idx, list(value) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v FROM ts_h), pr AS (SELECT x.idx, x.v AS a, y.v AS b FROM l x JOIN l y ON y.idx = x.idx + 24 WHERE len(y.v) = 12)"""
#: A table of the recursion row by row: the row of before, and in it value by value.
TABLE = """, d AS (SELECT idx, list_reduce(list_prepend({first}, list_transform(range({lo}, {hi}), lambda i: [i::DOUBLE])), lambda up, ii: list_reduce(list_prepend([{left}], list_transform(range({lo}, {hi}), lambda j: [j::DOUBLE])),
    lambda row, jj: list_append(row, {step}))) AS t FROM pr)"""
ROUND = " SELECT 'hourly' AS series_id, idx, round({}, 6) AS distance FROM {}"
_I, _J = "ii[1]::INTEGER", "jj[1]::INTEGER"
DISTANCE_SQL = {
    "mahalanobis": WINDOWS.replace("+ 4", "+ 11").replace("- 4", "- 11") + ", pr AS (SELECT a.idx, sum(pow(a.value - b.value, 2)) AS square, count(*) AS n, sum(a.value + b.value) AS s, sum(a.value * a.value + b.value * b.value) AS ss FROM w a JOIN w b ON b.idx = a.idx + 24 AND a.lag = b.lag GROUP BY 1) SELECT 'hourly' AS series_id, idx, round(sqrt(square / (ss / (2 * n) - pow(s / (2 * n), 2))), 6) AS distance FROM pr",
    "dtw": PAIRS + TABLE.format(first="list_prepend(0::DOUBLE, list_transform(range(12), lambda x: 'inf'::DOUBLE))", lo=1, hi=13, left="'inf'::DOUBLE", step=f"abs(a[{_I}] - b[{_J}]) + least(up[{_J} + 1], row[{_J}], up[{_J}])") + ROUND.format("t[13]", "d"),
    "edr": PAIRS + TABLE.format(first="list_transform(range(13), lambda x: x::DOUBLE)", lo=1, hi=13, left="ii[1]", step=f"least(up[{_J} + 1] + 1, row[{_J}] + 1, up[{_J}] + (abs(a[{_I}] - b[{_J}]) > 0.1)::INTEGER)") + ROUND.format("t[13] / 12", "d"),
    "twed": PAIRS.replace("x.v AS a, y.v AS b", "list_prepend(0::DOUBLE, x.v) AS a, list_prepend(0::DOUBLE, y.v) AS b")
    + TABLE.format(first="list_prepend(0::DOUBLE, list_transform(range(12), lambda x: 'inf'::DOUBLE))", lo=2, hi=14, left="'inf'::DOUBLE", step=f"least(up[{_J}] + abs(a[{_I}] - a[{_I} - 1]) + 0.101::DOUBLE, row[{_J} - 1] + abs(b[{_J}] - b[{_J} - 1]) + 0.101::DOUBLE, up[{_J} - 1] + abs(a[{_I}] - b[{_J}]) + abs(a[{_I} - 1] - b[{_J} - 1]) + 0.002::DOUBLE * abs({_I} - {_J}))") + ROUND.format("t[13]", "d"),
}
for _name in ("dtw", "edr", "twed", "mahalanobis", "sbd", "garch"):
    query(f"distance_{_name}", DISTANCE_SQL.get(_name))(lambda spark, sf, name=_name: rounded(ft.sequence_distance(window_pairs(spark, sf), name).select("series_id", "idx", "distance"), "distance"))


@query("garch_given", PAIRS + """, r AS (SELECT idx, a, b, list_transform(range(1, 13), lambda i: pow(10 * (a[i] - b[i]), 2)) AS q FROM pr),
    h AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: pow(0.94::DOUBLE, i - 1) * q[i])) / list_sum(list_transform(range(1, 13), lambda i: pow(0.94::DOUBLE, i - 1))) AS back FROM r),
    s AS (SELECT idx, a, b, list_transform(range(1, 13), lambda t: list_reduce(list_prepend(5 + 0.9::DOUBLE * back, q[1 : t - 1]), lambda h, x: 5 + 0.1::DOUBLE * x + 0.8::DOUBLE * h)) AS h FROM h)
    SELECT 'hourly' AS series_id, idx, round(list_sum(list_transform(range(1, 13), lambda i: abs(a[i] - b[i]) / (sqrt(h[i]) / 10))) / 12, 6) AS distance FROM s""")
def garch_given(spark: SparkSession, sf: str) -> DataFrame:
    """Differences over the deviations of a volatility recursion at given parameters."""
    found = ft.sequence_distance(window_pairs(spark, sf), "garch", params=(5.0, 0.1, 0.8))
    return rounded(found.select("series_id", "idx", "distance"), "distance")


@query("line_distance", "RECURSIVE" + """
    l AS (SELECT idx, list(round(value, 4)) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v FROM ts_h), pr AS (SELECT x.idx, x.v AS a, y.v AS b FROM l x JOIN l y ON y.idx = x.idx + 24 WHERE len(y.v) = 12),
    side AS (SELECT idx, 0 AS side, a AS x FROM pr UNION ALL SELECT idx, 1, b FROM pr),
    kn AS (SELECT idx, side, x, 1::BIGINT AS p FROM side UNION ALL
           SELECT idx, side, x, list_filter(range(p + 2, 13), lambda t: abs(x[t] - (x[p] + (x[p + 1] - x[p]) * (t - p))) >= 5)[1] FROM kn WHERE len(list_filter(range(p + 2, 13), lambda t: abs(x[t] - (x[p] + (x[p + 1] - x[p]) * (t - p))) >= 5)) > 0),
    ks AS (SELECT idx, side, any_value(x) AS x, list(p) AS k FROM kn GROUP BY 1, 2), every AS (SELECT DISTINCT idx, p FROM kn),
    val AS (SELECT idx, e.p, side, x, list_max(list_filter(k, lambda z: z <= e.p)) AS q FROM every e JOIN ks USING (idx)),
    g AS (SELECT idx, p, abs(max(CASE WHEN side = 0 THEN y END) - max(CASE WHEN side = 1 THEN y END)) AS gap FROM (SELECT idx, p, side, CASE WHEN q = p THEN x[p] ELSE x[q] + (x[q + 1] - x[q]) * (p - q) END AS y FROM val) GROUP BY 1, 2)
    SELECT 'hourly' AS series_id, idx, round(avg(gap), 7) AS distance FROM g GROUP BY idx""")
def line_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the lines that two windows are cut into."""
    pairs = window_pairs(spark, sf, lambda h: h.withColumn("value", F.round("value", 4)))
    return dist.line_distance(pairs, 5.0).select("series_id", "idx", F.round("distance", 7).alias("distance"))


@query("covariance_distance", """p AS (SELECT a.idx, a.value - c.value AS x, b.value - d.value AS y FROM ts_h a JOIN ts_h b ON b.idx = a.idx + 1 JOIN ts_h c ON c.idx = a.idx + 24 JOIN ts_h d ON d.idx = a.idx + 25),
    m AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p) SELECT 'hourly' AS series_id, idx, round(sqrt((yy * x * x - 2 * xy * x * y + xx * y * y) / (xx * yy - xy * xy)), 6) AS distance FROM p, m""")
def covariance_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of windows of two hours, a day apart, in units of their covariance over the series."""
    return rounded(dist.covariance_distance(window_pairs(spark, sf, width=2)), "distance")


SEASONS = """c AS (SELECT series_id, idx, value, CASE WHEN count(*) OVER f = 25 THEN (sum(value) OVER g + (lag(value, 12) OVER o + lead(value, 12) OVER o) / 2) / 24 END AS t FROM {t}
        WINDOW o AS (PARTITION BY series_id ORDER BY idx), f AS (o ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), g AS (o ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)),
    z AS (SELECT series_id, min(idx) AS lo, max(idx) AS hi FROM c WHERE t IS NOT NULL GROUP BY 1 HAVING count(*) > 24),
    e AS (SELECT series_id, any_value(lo) AS lo, any_value(hi) AS hi, regr_slope(t, idx) FILTER (idx < lo + 24) AS sa, regr_intercept(t, idx) FILTER (idx < lo + 24) AS ia, regr_slope(t, idx) FILTER (idx > hi - 24) AS sb, regr_intercept(t, idx) FILTER (idx > hi - 24) AS ib FROM c JOIN z USING (series_id) WHERE t IS NOT NULL GROUP BY 1),
    w AS (SELECT series_id, idx, value, CASE WHEN idx < lo THEN ia + sa * idx WHEN idx > hi THEN ib + sb * idx ELSE t END AS trend FROM c JOIN e USING (series_id)),
    ph AS (SELECT series_id, idx % 24 AS k, avg(value - trend) AS m FROM w GROUP BY 1, 2), sn AS (SELECT series_id, k, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM ph)
    SELECT w.series_id, idx, round(trend, 7) AS trend, round(seasonal, 7) AS seasonal, round(value - trend - seasonal, 7) AS residual FROM w JOIN sn ON sn.series_id = w.series_id AND sn.k = w.idx % 24"""


@query("decomposition", SEASONS.format(t="ts_u"))
def decomposition(spark: SparkSession, sf: str) -> DataFrame:
    found = seasons.decompose(s.event_series(spark, sf), 24)
    return found.select("series_id", "idx", *(F.round(c, 7).alias(c) for c in ("trend", "seasonal", "residual")))


@query("optimal_bins", """r AS (SELECT series_id, lag, round(value, 9) AS v FROM lags_m), en AS (SELECT series_id, lag, min(v) AS lo, max(v) AS hi, count(*) AS n FROM r GROUP BY 1, 2 HAVING min(v) < max(v)), tr AS (SELECT *, unnest(range(1, greatest(floor(sqrt(n))::INTEGER, 2))) AS b FROM en),
    c AS (SELECT tr.lag, n, b, least(floor((v - lo) / (hi - lo) * b), b - 1) AS bin, count(*) AS c FROM tr JOIN r ON r.lag = tr.lag GROUP BY 1, 2, 3, 4), g AS (SELECT lag, b, sum(c * ln(b * c::DOUBLE / n + 1)) - b * (b - 1 + pow(ln(b), 2.5)) AS gain FROM c GROUP BY 1, 2, n)
    SELECT 'shipments' AS series_id, lag, arg_max(b, struct_pack(gain := gain, b := -b))::INTEGER AS bins FROM g GROUP BY 2""")
def optimal_bins(spark: SparkSession, sf: str) -> DataFrame:
    return ft.optimal_bins(d.channel_values(s.shipment_series(spark, sf)).withColumn("value", F.round("value", 9)))


@query("similarity", "st AS (SELECT lag, avg(value) AS m, stddev_pop(value) AS s FROM lags_m GROUP BY 1) SELECT series_id, idx, round(pow(2, -0.5 * avg(pow((value - m) / s, 2))), 6) AS similarity FROM lags_m JOIN st USING (lag) GROUP BY 1, 2")
def similarity(spark: SparkSession, sf: str) -> DataFrame:
    points = s.shipment_series(spark, sf).select("series_id", "idx", F.col("features").alias("v"))
    return rounded(ft.similarity(points, 0.5), "similarity")


@query("weighted_pearson", "q AS (SELECT l_returnflag AS series_id, l_quantity::DOUBLE AS w, l_extendedprice::DOUBLE AS x, l_discount::DOUBLE AS y FROM lineitem), mn AS (SELECT series_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM q GROUP BY 1) SELECT series_id, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * pow(x - mx, 2)) * sum(w * pow(y - my, 2))), 6) AS pearson FROM q JOIN mn USING (series_id) GROUP BY 1")
def weighted_pearson(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("series_id"), *(F.col(a).cast("double").alias(b) for a, b in (("l_quantity", "w"), ("l_extendedprice", "x"), ("l_discount", "y"))))
    return rounded(ft.weighted_correlation(items), "pearson")


@query("split_down_sample", "SELECT * FROM (SELECT series_id, idx, idx < floor(0.7::DOUBLE * count(*) OVER (PARTITION BY series_id)) AS is_train FROM ts_u) WHERE idx % 4 = 0")
def split_down_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of each series for training, every fourth point of it."""
    return fr.split_valid(s.event_series(spark, sf), 0.3).filter("idx % 4 = 0").select("series_id", "idx", "is_train")


@query("overlapping_runs", RUNS + ", late AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s)::INTEGER AS seg_id, s + 2 AS s, e + 40 AS e FROM runs) SELECT a.series_id, a.seg_id AS a_id, b.seg_id AS b_id, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared FROM runs a JOIN late b ON a.series_id = b.series_id AND a.s <= b.e AND b.s <= a.e")
def overlapping_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = materialise(sg.runs(s.event_series(spark, sf)))
    return sg.overlaps(found, found.withColumns({"s": F.col("s") + 2, "e": F.col("e") + 40}))


# Streams' batch twins


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@query("tumbling", """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return st.tumbling(_events(spark, sf))


@query("sliding", """h AS (SELECT *, unnest([0, 1, 2]) AS k FROM events) SELECT event_type, date_trunc('day', ts) + INTERVAL 2 HOUR * (hour(ts) // 2 - k) AS start, date_trunc('day', ts) + INTERVAL 2 HOUR * (hour(ts) // 2 - k + 3) AS "end", count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM h GROUP BY 1, 2, 3""")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return st.sliding(_events(spark, sf))


@query("sessions", """f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM g GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return st.sessions(_events(spark, sf), "12 hours")


@query("registry_cover")
def registry_cover(spark: SparkSession, sf: str) -> DataFrame:
    """For each registered detector: how many of the series with enough points it scores without an error, on the first channel or all; 0 for those that aren't available."""
    hourly, shipments = s.hourly_series(spark, sf), s.shipment_series(spark, sf)
    parts = []
    for entry in REGISTRY.values():
        if entry.run is None:
            continue
        scores = detect(shipments if entry.channels else hourly, entry.name, **{k: min(v, 24) for k, v in entry.params.items() if k == "width"})
        parts.append(scores.groupBy("detector", "series_id").agg(F.max("error").alias("error"), F.count("score").alias("points")))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    done = done.groupBy("detector").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("series"), F.sum("points").alias("points"))
    names = spark.createDataFrame([(r.name, r.run is not None, r.semi, r.channels) for r in REGISTRY.values()], "detector string, available boolean, semi boolean, channels boolean")
    return names.join(done, "detector", "left").fillna(0, ["series", "points"])


@query("sketch_sizes", "SELECT event_type AS series_id, CAST(ts AS DATE) AS day, count(*) AS n, true AS close FROM events GROUP BY 1, 2")
def sketch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many values the sketch of each day holds, and whether its median is one of ranks 40 to 60 in a hundred."""
    rows = s.event_series(spark, sf).select("series_id", F.to_date("ts").alias("day"), F.col("value").alias("score"))
    days = sk.daily(rows, F.col("day")).withColumn("median", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    ranks = rows.join(days.select("series_id", "day", "median"), ["series_id", "day"]).groupBy("series_id", "day").agg(F.count("*").alias("n"), F.sum((F.col("score") < F.col("median")).cast("int")).alias("under"), F.sum((F.col("score") <= F.col("median")).cast("int")).alias("upto"))
    close = (F.col("under") <= 0.6 * F.col("n")) & (F.col("upto") >= 0.4 * F.col("n"))
    return ranks.select("series_id", "day", "n", close.alias("close"))


# From SQL


@query("sql_segments", RUNS + " SELECT * FROM runs")
def sql_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of labels by a table function."""
    sql.register_functions(spark)
    s.event_series(spark, sf).createOrReplaceTempView("series")
    return spark.sql("SELECT series_id, seg_id, s, e FROM anomaly_segments(TABLE(SELECT series_id, idx, label FROM series) PARTITION BY series_id ORDER BY idx)")


@query("sql_measures", """sc AS (SELECT u.series_id, u.idx, u.label, coalesce(pow(u.value - b.value, 2), 0) AS score FROM ts_u u LEFT JOIN ts_u b ON b.series_id = u.series_id AND b.idx = u.idx - 24),
    st AS (SELECT series_id, score, count(*) AS n0, sum(label) AS p0 FROM sc GROUP BY 1, 2), c AS (SELECT *, sum(n0) OVER o AS nc, sum(p0) OVER o AS pc, sum(n0) OVER (PARTITION BY series_id) AS n, sum(p0) OVER (PARTITION BY series_id) AS p FROM st WINDOW o AS (PARTITION BY series_id ORDER BY score DESC))
    SELECT series_id, round(sum((n0 - p0) * (pc - p0 / 2)) / max(p * (n - p)), 6) AS auc_roc, round(sum(p0::DOUBLE / p * pc / nc), 6) AS auc_pr, round(sum((n0 - p0) * (pc - p0 / 2)) / max(p * (n - p)), 6) AS by_aggregate FROM c WHERE p > 0 GROUP BY 1""")
def sql_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of a detector by its view, and by an aggregate over the view of its scores."""
    sql.publish(spark, s.event_series(spark, sf), {"Seasonal": {}})
    return spark.sql("""SELECT m.series_id, round(m.auc_roc, 6) AS auc_roc, round(m.auc_pr, 6) AS auc_pr, round(a.area, 6) AS by_aggregate
        FROM measures_seasonal m JOIN (SELECT series_id, auc_roc(score, label) AS area FROM scores_seasonal GROUP BY series_id) a ON a.series_id = m.series_id""")


# Models and scores that are kept


@query("model_pca", """r AS (SELECT v, list_avg(v) AS m, list_stddev_samp(v) AS d FROM vec WHERE idx % 2 = 0),
    m AS (SELECT unnest(range(len(v)))::INTEGER AS row, unnest(list_transform(v, lambda x: CASE WHEN d = 0 THEN 0 ELSE (x - m) / d END)) AS x FROM r)
    SELECT 'vec' AS series_id, row, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM m GROUP BY row""")
def model_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Means and variances that principal components of half of the vectors are fitted with, from the stored model."""
    path = scratch(spark, "models")
    half = s.point_set(spark, sf).filter("idx % 2 = 0")
    fitted.save(fitted.fit(half, "PCA"), path)
    numbers = fitted.coefficients(fitted.load(spark, path, "PCA"))
    mean = numbers.filter("part = 'mean'").select("series_id", "row", F.round("value", 6).alias("mean"))
    return mean.join(numbers.filter("part = 'deviation'").select("series_id", "row", F.round(F.pow("value", 2), 6).alias("variance")), ["series_id", "row"])


@query("model_scores")
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all vectors by a forest that half of them were stored with."""
    path = scratch(spark, "models")
    vectors = s.point_set(spark, sf)
    fitted.save(fitted.fit(vectors.filter("idx % 2 = 0"), "EIF"), path)
    return rounded(fitted.score(vectors, fitted.load(spark, path, "EIF")), "score")


@query("stored_scores", "SELECT u.series_id, 'Seasonal' AS detector, u.idx, round(coalesce(pow(u.value - b.value, 2), 0), 6) AS score FROM ts_u u LEFT JOIN ts_u b ON b.series_id = u.series_id AND b.idx = u.idx - 24")
def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a run that is broken off before it is complete, and repeated twice."""
    sink = ScoreSink(spark, scratch(spark, "scores"))
    u = materialise(s.event_series(spark, sf))
    sink.begin(detect(u, "Seasonal").withColumn("params", F.lit("{}")))
    for _ in range(2):
        sink.run(u, [("Seasonal", {})], chunks=2)
    return rounded(sink.read().select("series_id", "detector", "idx", "score"), "score")
