"""Models of detectors as tables: fitted once, kept, and used later on the same or on other series.

A row is a model: series_id, detector, version, params (as JSON) and model (bytes in the plain format of
``tidewatch.operators.plain``, so loading a table runs nothing that the table says).  Scores are those of ``detect``
where model and series are the same.  Windows are normalised by the series that is scored, as the detectors do.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.plain import unpack
from tidewatch.plans.registry import MODELLED, REGISTRY

TABLE = "series_id string, params string, model binary, detector string, version int"


def _checked(name: str, params: dict[str, Any]) -> dict[str, Any]:
    if name not in MODELLED:
        raise ValueError(f"{name!r} keeps no model; those that do: {', '.join(sorted(MODELLED))}")
    if unknown := set(params) - set(REGISTRY[name].params):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return {**REGISTRY[name].params, **params}


def fit(series: DataFrame, name: str, version: int = 1, **params: Any) -> DataFrame:
    """A model of each series: of all its points, or of those marked by a column ``train``."""
    given = _checked(name, params)
    models = MODELLED[name].fit(series, "train" in series.columns, **given)
    return models.select("series_id", F.lit(json.dumps(given, sort_keys=True)).alias("params"), "model", F.lit(name).alias("detector"), F.lit(version).alias("version"))


def save(models: DataFrame, path: str) -> None:
    """Add models to the table at ``path``; a version is written once, so that what was scored by it can be told again."""
    spark = models.sparkSession
    new = models.select("detector", "version").distinct().collect()  # as many as configurations fitted at once
    old = {(r["detector"], r["version"]) for r in _stored(spark, path).select("detector", "version").distinct().collect()}
    if again := sorted({(r["detector"], r["version"]) for r in new} & old):
        raise ValueError("stored already: " + ", ".join(f"{d} version {v}" for d, v in again))
    models.write.mode("append").partitionBy("detector", "version").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TABLE).parquet(path)
    except Exception as e:  # nothing was stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLE)


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """The models of a detector, of one version or of the last one."""
    own = _stored(spark, path).filter(F.col("detector") == name)
    last = version if version is not None else own.agg(F.max("version")).first()[0]
    return own.filter(F.col("version") == F.lit(last).cast("int"))


def score(series: DataFrame, models: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """series_id, detector, version, idx, score and error of the series by the models of their own, or by those that ``of`` (series_id, model_of) names.

    Models of several detectors, versions or parameters score the series each; there is a plan for each of these.
    """
    kinds = models.select("detector", "version", "params").distinct().orderBy("detector", "version", "params").collect()
    if not kinds:
        raise ValueError("no models")
    parts = []
    for detector, version, params in kinds:
        own = models.filter((F.col("detector") == detector) & (F.col("version") == version) & (F.col("params") == params)).select("series_id", "model")
        if of is not None:
            named = of.select(F.col("series_id").alias("_series"), "model_of")
            own = own.join(named, F.col("series_id") == F.col("model_of")).select(F.col("_series").alias("series_id"), "model")
        scored = MODELLED[detector].score(series.drop("train"), own, **_checked(detector, json.loads(params)))
        parts.append(scored.select("series_id", F.lit(detector).alias("detector"), F.lit(version).alias("version"), "idx", "score", "error"))
    return reduce(DataFrame.unionByName, parts)


#: Names of the arrays that models of a kind begin with.
PARTS = {"PCA": ("columns", "mean", "deviation", "variance", "vectors"), "MCD": ("mean", "inverse"), "CBLOF": ("centres", "sizes", "large"), "KMeansAD": ("centres",)}
PARTS |= {"Sub_PCA": PARTS["PCA"], "Sub_MCD": PARTS["MCD"], "KMeansAD_U": PARTS["KMeansAD"], "LinearForecast": ("map",), "FITS": ("map",)}


def coefficients(models: DataFrame) -> DataFrame:
    """series_id, detector, version, part, row, column and value: the numbers of models that are arrays (all but forests), for SQL."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (series, detector, version, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("series_id", "detector", "version", "model")))):
                model = unpack(data)
                arrays = dict(zip(PARTS.get(detector, ()), model if isinstance(model, tuple) else (model,)))
                for part, x in arrays.items():
                    flat = np.asarray(x, float)
                    flat = flat.reshape(len(flat), -1)
                    row, column = np.indices(flat.shape).reshape(2, -1)
                    n = flat.size
                    yield pa.RecordBatch.from_arrays([pa.array([series] * n, pa.string()), pa.array([detector] * n, pa.string()), pa.array([version] * n, pa.int32()), pa.array([part] * n, pa.string()), pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(flat.ravel())], ["series_id", "detector", "version", "part", "row", "column", "value"])

    return models.select("series_id", "detector", "version", "model").mapInArrow(run, "series_id string, detector string, version int, part string, row int, column int, value double")
