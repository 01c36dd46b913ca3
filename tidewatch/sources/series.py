"""Canonical series: series_id, idx (from 0), value or features, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import sums
from tidewatch.operators.segments import runs

#: The parts of a series' file name, in order.
NAME = r"^(\d+)_(.+)_id_(\d+)_(\w+)_tr_(\d+)_1st_(\d+)\.csv$"


def number(df: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Add idx, the position of a row in its series.

    ``bucket`` must ascend with ``order``.  Rows are numbered inside (series, bucket), and only the buckets' sizes are
    summed up over a series, so that a long series is numbered by many tasks.
    """
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = dealt.withColumn("_row", F.row_number().over(inside)).join(bases, [*keys, "_bucket"])
    return out.withColumn("idx", (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "_base")


def range_label(ts: str = "ts") -> Column:
    return ((F.dayofmonth(ts) % 7 == 3) & F.hour(ts).between(6, 11)).cast("int")


def point_label() -> Column:
    return (F.get_json_object("props", "$.k").cast("int") >= 95).cast("int")


def day_label(day: str) -> Column:
    return ((F.dayofmonth(day) == 13) | (F.month(day) == 7) & (F.dayofmonth(day) <= 5)).cast("int")


def event_series(spark: SparkSession, sf_dir: str, label: Column | None = None) -> DataFrame:
    """One series for each event type: series_id, idx, ts, value, label."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_type").alias("series_id"), "event_id", "ts", "value", (label if label is not None else range_label()).alias("label"))
    return number(rows, ["series_id"], F.to_date("ts"), ["ts", "event_id"]).select("series_id", "idx", "ts", "value", "label")


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the mean value of all events of each hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"), F.max(range_label()).alias("label"))
    return number(hours.withColumn("series_id", F.lit("hourly")), ["series_id"], F.to_date("ts"), ["ts"]).select("series_id", "idx", "ts", "value", "label")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the total price of each day's orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    rows = days.select(F.lit("daily").alias("series_id"), "ts", "value", day_label("ts").alias("label"))
    return number(rows, ["series_id"], F.date_trunc("month", "ts"), ["ts"]).select("series_id", "idx", "ts", "value", "label")


def shipment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of four channels: mean quantity, price, discount and tax of each day's line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    means = [sums.mean(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    days = items.groupBy(F.col("l_shipdate").alias("ts")).agg(F.array(*means).alias("features"))
    rows = days.select(F.lit("shipments").alias("series_id"), "ts", "features", day_label("ts").alias("label"))
    return number(rows, ["series_id"], F.date_trunc("month", "ts"), ["ts"]).select("series_id", "idx", "ts", "features", "label")


def point_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a set of points; label 3 is the anomaly."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.lit("vec").alias("series_id"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 3).cast("int").alias("label"))


def name_metadata(names: DataFrame, column: str = "file_name") -> DataFrame:
    """file_name, series_no, dataset, id, domain, train_index and first_anomaly from the file names."""
    part = lambda i: F.regexp_extract(column, NAME, i)
    return names.select(F.col(column).alias("file_name"), part(1).cast("int").alias("series_no"), part(2).alias("dataset"), part(3).cast("int").alias("id"), part(4).alias("domain"), part(5).cast("int").alias("train_index"), part(6).cast("int").alias("first_anomaly"))


def _placed(rows: DataFrame, *columns: Column) -> DataFrame:
    """Rows of files with the file's path, where the piece of the file begins that the row's task reads, and a number that ascends in it."""
    return rows.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def csv_series(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """Files with channels and a last column Label, by line; lines with a null are dropped before they are numbered.

    A large file is read in pieces by several tasks (``spark.sql.files.maxPartitionBytes``); lines are numbered inside
    their piece, and only the pieces' sizes are summed up over a file.
    """
    names = [f"c{i}" for i in range(channels)]
    schema = ", ".join(f"{n} double" for n in names) + ", Label double"
    rows = _placed(spark.read.schema(schema).csv(path, header=True), *map(F.col, names), F.col("Label").cast("int").alias("label")).na.drop("any")
    numbered = number(rows, ["_path"], F.col("_block"), ["_line"])
    return numbered.select(F.element_at(F.split("_path", "/"), -1).alias("series_id"), "idx", (F.col("c0").alias("value") if channels == 1 else F.array(*names).alias("features")), "label")


def restrict(series: DataFrame, file_list: DataFrame) -> DataFrame:
    """Series whose name is in the list."""
    return series.join(file_list.select(F.col("file_name").alias("series_id")), "series_id", "left_semi")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text or gzip files named dataset_algorithm.gz with 0 or 1 on each line: dataset, algorithm, idx, label."""
    rows = number(_placed(spark.read.text(path), F.col("value")), ["_path"], F.col("_block"), ["_line"])
    name = lambda i: F.regexp_extract("_path", r"([^/]+)_([^/_]+)\.gz$", i)
    return rows.select(name(1).alias("dataset"), name(2).alias("algorithm"), "idx", F.col("value").cast("int").alias("label"))


def label_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of such files: dataset, algorithm, s and e (the first and last index) of each run of ones."""
    rows = label_files(spark, path).withColumn("series_id", F.to_json(F.struct("dataset", "algorithm")))
    named = rows.select("series_id", "dataset", "algorithm").distinct()
    return runs(rows).join(named, "series_id").select("dataset", "algorithm", "s", "e")


def profile(series: DataFrame) -> DataFrame:
    """Length, labels and moments of each series."""
    return series.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
