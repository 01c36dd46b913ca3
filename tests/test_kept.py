"""Models and scores that are kept, and files read in pieces."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models
from tidewatch.operators.plain import pack, unpack
from tidewatch.plans import fitted
from tidewatch.plans.registry import MODELLED, REGISTRY, detect, register
from tidewatch.sources import series as sources
from tidewatch.sources.sink import ScoreSink


def wave(spark, names="ab", n=300, shift=0.0):
    rng = np.random.default_rng(7)
    rows = [(s, i, float(np.sin(i / 5 + shift) + rng.normal(0, 0.1) + 4 * (i == 200))) for s in names for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double")


def channels(spark, n=300):
    x = np.random.default_rng(8).normal(size=(n, 3))
    return spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(x)], "series_id string, idx long, features array<double>")


def sorted_rows(df):
    return [(r.series_id, r.idx, r.score) for r in df.select("series_id", "idx", "score").orderBy("series_id", "idx").collect()]


def alike(a, b):
    """The same points with the same scores, but for the order in which sums were added up."""
    a, b = sorted_rows(a), sorted_rows(b)
    return [r[:2] for r in a] == [r[:2] for r in b] and np.allclose(*(np.array([r[2] for r in x], float) for x in (a, b)), rtol=1e-6, equal_nan=True)


def test_plain_models_come_back_as_they_were():
    model = (3, None, "x", 1.5, np.arange(6).reshape(2, 3), (np.array([True]), [np.zeros((0, 2)), 7]))
    got = unpack(pack(model))
    assert got[:4] == model[:4] and (got[4] == model[4]).all() and got[5][1][0].shape == (0, 2) and got[5][1][1] == 7
    with pytest.raises(TypeError):
        pack(print)
    for data in (b"", b"\xff" * 20, pack(model)[:-8], pack(1)[:8] + b'{"array": "O", "shape": [1]}'):
        with pytest.raises(ValueError):
            unpack(data)


def _stored(data, tmp_path):
    data.write.parquet(str(tmp_path / "series"))
    return str(tmp_path / "series")


@pytest.mark.parametrize("name", sorted(MODELLED))
def test_stored_models_score_as_one_pass(spark, tmp_path, name):
    """Fitted on the first half, stored, loaded in another session: the scores of one pass that is trained on that half."""
    data = channels(spark) if REGISTRY[name].channels else wave(spark)
    params = {"width": 20} if "width" in REGISTRY[name].params else {}
    marked = data.withColumn("train", F.col("idx") < 150)
    path = str(tmp_path / "models")
    fitted.save(fitted.fit(marked, name, **params), path)
    other = spark.newSession()
    loaded = fitted.load(other, path, name)
    assert set(loaded.columns) == {"series_id", "params", "model", "detector", "version"}
    got = fitted.score(other.read.parquet(_stored(data, tmp_path)), loaded)
    entry = MODELLED[name]
    given = {**REGISTRY[name].params, **params}
    want = entry.score(data, entry.fit(marked, True, **given), **given)
    assert alike(got, want)
    assert loaded.count() == data.select("series_id").distinct().count()
    if REGISTRY[name].semi:
        assert alike(got, detect(marked, name, **params))


def test_models_of_one_series_score_another(spark, tmp_path):
    path = str(tmp_path / "models")
    fitted.save(fitted.fit(wave(spark, "a"), "Sub_PCA", width=10), path)
    fitted.save(fitted.fit(wave(spark, "a", shift=1.0), "Sub_PCA", version=2, width=10), path)
    with pytest.raises(ValueError, match="stored already"):
        fitted.save(fitted.fit(wave(spark, "a"), "Sub_PCA", version=2, width=10), path)
    of = spark.createDataFrame([("z", "a"), ("y", "a")], "series_id string, model_of string")
    got = fitted.score(wave(spark, "zyx"), fitted.load(spark, path, "Sub_PCA", 1), of)
    assert {(r.series_id, r.version) for r in got.filter("score IS NOT NULL").select("series_id", "version").distinct().collect()} == {("z", 1), ("y", 1)}
    same = fitted.score(wave(spark, "z"), fitted.fit(wave(spark, "z"), "Sub_PCA", width=10))
    assert np.allclose([r.score for r in got.filter("series_id = 'z'").orderBy("idx").collect()], [r.score for r in same.orderBy("idx").collect()])
    assert fitted.load(spark, path, "Sub_PCA").select("version").distinct().collect()[0][0] == 2
    with pytest.raises(ValueError, match="keeps no model"):
        fitted.fit(wave(spark), "SR")


def test_parts_of_a_model_are_added_one_by_one(spark, monkeypatch):
    """More parts than a task may hold of a series: what is held is a total and a part."""
    held = []
    add = models._add
    monkeypatch.setattr(models, "_add", lambda a, b: held.append(1) or add(a, b))
    data = channels(spark, 2_000).withColumn("v", F.col("features")).repartition(200)
    one = fitted.unpack(models.principal.fit(data).first()["model"])
    x = np.array([r.v for r in data.orderBy("idx").collect()])
    assert np.allclose(one[1], x.mean(axis=0)) and np.allclose(one[2], x.std(axis=0))


def seconds_fail(spark, name, state):
    def run(series, **params):
        state["runs"] += 1
        if state["runs"] == state["fails"]:
            raise RuntimeError("killed")
        return series.select("series_id", "idx", (F.col("value") * 2).alias("score"))

    register(name, run)


def test_scores_are_stored_once_whatever_is_killed(spark, tmp_path):
    series = wave(spark, "abcdefgh", 20)
    state = {"runs": 0, "fails": 3}
    seconds_fail(spark, "Broken", state)
    sink = ScoreSink(spark, str(tmp_path / "scores"))
    assert sink.read().count() == 0
    with pytest.raises(RuntimeError, match="killed"):
        sink.run(series, [("Broken", {})], chunks=4)
    stored = sink.read().select("series_id").distinct().count()
    assert 0 < stored < 8
    sink.begin(detect(series, "Broken").withColumn("params", F.lit("{}")))  # written, never complete
    before = state["runs"]
    sink.run(series, [("Broken", {})], chunks=4)
    sink.run(series, [("Broken", {})], chunks=4)
    assert state["runs"] - before <= 3  # parts that were stored are not scored again
    got = sink.read()
    assert got.count() == got.select("series_id", "idx").distinct().count() == 160
    assert not REGISTRY.pop("Broken").semi


def test_runs_at_the_same_time_count_once(spark, tmp_path):
    sink = ScoreSink(spark, str(tmp_path / "scores"))
    rows = [("D", "{}", "007", i, float(i)) for i in range(5)]
    scores = spark.createDataFrame(rows, "detector string, params string, series_id string, idx long, score double")
    one, two = sink.begin(scores), sink.begin(scores)
    sink.commit(two)
    sink.commit(one)
    got = sink.read()
    assert got.count() == 5 and got.first()["series_id"] == "007" and dict(got.dtypes)["series_id"] == "string"
    assert sink.committed().first()["run"] == two
    assert sink.missing(scores).count() == 0


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    lines = [f"{i}.5,{i % 2}" for i in range(4_000)]
    lines[7] = ",1"
    (tmp_path / "x.csv").write_text("\n".join(["v,Label", *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sources._placed(spark.read.schema("c0 double, Label double").csv(str(tmp_path), header=True), F.col("c0"))
        assert rows.select("_block").distinct().count() > 5
        got = [(r.series_id, r.idx, r.value, r.label) for r in sources.csv_series(spark, str(tmp_path)).orderBy("idx").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [i for i in range(4_000) if i != 7]
    assert got == [("x.csv", k, i + 0.5, i % 2) for k, i in enumerate(kept)]


def test_label_files_and_their_events(spark, tmp_path):
    for name, bits in (("set_one_A.gz", "0110001"), ("set_one_B.gz", "1111111"), ("two_A.gz", "0000000")):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(bits) + "\n")
    rows = [(r.dataset, r.algorithm, r.idx, r.label) for r in sources.label_files(spark, str(tmp_path)).orderBy("dataset", "algorithm", "idx").collect()]
    assert rows[:3] == [("set_one", "A", 0, 0), ("set_one", "A", 1, 1), ("set_one", "A", 2, 1)] and len(rows) == 21
    events = {(r.dataset, r.algorithm, r.s, r.e) for r in sources.label_events(spark, str(tmp_path)).collect()}
    assert events == {("set_one", "A", 1, 2), ("set_one", "A", 6, 6), ("set_one", "B", 0, 6)}


def test_restrict_to_a_list(spark):
    names = spark.createDataFrame([("a",)], "file_name string")
    assert sources.restrict(wave(spark), names).select("series_id").distinct().collect()[0][0] == "a"
