"""Scores stored exactly once, whatever is killed on the way.

A run writes its scores to a folder of its own, then what they are (a row for each detector, parameters and series, the
manifest), then one small file that says that the run is complete.  Only complete runs are read; where two have the
same scores, because they ran at the same time, those of the first count.  What a killed run left is never read, and
the run that repeats it finds only what is missing.  Scores lie in a fixed number of folders by a hash of the series,
so any number of series can be stored, and the names of series stay what they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.registry import detect

KEYS = ["detector", "params", "series_id"]
SCORES = "detector string, params string, series_id string, idx long, score double, error string, bucket int, run string"
MANIFEST = "detector string, params string, series_id string, n long, run string"
COMMITS = "at timestamp, run string"
#: Folders of scores.
BUCKETS = 64


@dataclass(frozen=True)
class ScoreSink:
    spark: SparkSession
    path: str

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        """detector, params, series_id, n (points) and run: of each the first complete run that has it."""
        first = F.min(F.struct("at", "run", "n")).alias("first")
        found = self._read("manifest", MANIFEST).join(self._read("commits", COMMITS), "run")
        return found.groupBy(*KEYS).agg(first).select(*KEYS, "first.n", "first.run")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (detector, params, series_id and more) whose scores aren't stored."""
        return wanted.join(self.committed(), KEYS, "left_anti")

    def begin(self, scores: DataFrame) -> str:
        """Write what is not stored yet, as a run that is not complete; gives the run."""
        run = uuid.uuid4().hex
        new = self.missing(scores.withColumn("error", F.col("error") if "error" in scores.columns else F.lit(None).cast("string")))
        new = new.select(*KEYS, "idx", "score", "error", F.pmod(F.xxhash64("series_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        new.repartition("bucket", F.floor(F.col("idx") / 1_000_000)).write.partitionBy("bucket").parquet(f"{self.path}/data/run={run}")
        return run

    def commit(self, run: str) -> None:
        """List what a run has written, then declare it complete by one file."""
        written = self._read("data", SCORES).filter(F.col("run") == run)
        written.groupBy(*KEYS).agg(F.count("*").alias("n")).write.parquet(f"{self.path}/manifest/run={run}")
        self.spark.range(0, 1, 1, 1).select(F.current_timestamp().alias("at")).write.parquet(f"{self.path}/commits/run={run}")

    def write(self, scores: DataFrame) -> None:
        """Store scores (detector, params, series_id, idx, score and, if there is one, error) that aren't stored yet."""
        self.commit(self.begin(scores))

    def read(self) -> DataFrame:
        """All stored scores, each once."""
        return self._read("data", SCORES).join(self.committed().drop("n"), [*KEYS, "run"]).drop("bucket", "run")

    def run(self, series: DataFrame, detectors: Iterable[tuple[str, dict[str, Any]]], chunks: int = 16) -> None:
        """Score every series by every detector (name, params) and store it, a part of the series at a time; what is stored is not worked out again.

        A run that is killed loses the part it was at.
        """
        ids = series.select("series_id").distinct()
        chunk = F.pmod(F.xxhash64("series_id", F.lit("chunk")), F.lit(chunks))
        for name, params in detectors:
            told = json.dumps(params, sort_keys=True)
            left = self.missing(ids.withColumn("detector", F.lit(name)).withColumn("params", F.lit(told))).withColumn("_chunk", chunk)
            for part in sorted(r[0] for r in left.select("_chunk").distinct().collect()):  # of so many chunks
                own = series.join(left.filter(F.col("_chunk") == part).select("series_id"), "series_id", "left_semi")
                self.write(detect(own, name, **params).withColumn("params", F.lit(told)))
