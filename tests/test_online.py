"""Detectors that learn from a stream: any cut into micro-batches gives what one batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.plain import pack, unpack
from tidewatch.plans.registry import detect
from tidewatch.streaming import online


def beat(n=900, period=20, seed=1):
    rng = np.random.default_rng(seed)
    v = np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(0, 0.05, n)
    v[n * 3 // 4 : n * 3 // 4 + period] *= -0.3
    return v


MACHINES = [online.OnlineShapes(10, k=3, start=200, batch=90), online.NewNormals(12, start=300)]


@pytest.mark.parametrize("machine", MACHINES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_cut_gives_the_same(machine, seed):
    v, rng = beat(), np.random.default_rng(seed)
    want = online.batch_scores(machine, v)
    cuts = np.sort(rng.choice(len(v), 20 * seed, replace=False))
    parts = np.split(np.arange(len(v)), cuts)
    if seed == 3:  # some come early, some again
        parts = [parts[i] for i in rng.permutation(len(parts))] + parts[:5]
    state, got = None, {}
    for part in parts:
        state, idx, scores = online.in_order(machine, state and unpack(pack(state)), part, v[part])
        got |= dict(zip(idx.tolist(), scores.tolist()))
    assert sorted(got) == list(range(len(want))) and len(want) > 700
    assert np.allclose([got[i] for i in range(len(want))], want, rtol=1e-9, atol=1e-12)  # but for the order in which products are added up


def test_shapes_find_the_odd_beat_and_keep_every_cluster():
    machine = online.OnlineShapes(10, k=3, start=200, batch=90)
    v = beat()
    scores = online.batch_scores(machine, v)
    assert 640 <= scores.argmax() <= 730
    rng = np.random.default_rng(5)
    machine = online.OnlineShapes(10, k=20, start=600, batch=90)
    state, _ = machine.feed(machine.begin(), rng.normal(size=3_600))
    assert len(state[4]) > 12 and state[7].sum() == (state[3]) // 15  # sub-sequences so far, one every 15 points: none was dropped
    assert len(state[0]) < 90 + 40


def test_gradients_are_those_of_small_steps():
    net, rng = online.Network.of_sizes([6, 3, 2, 6], 1), np.random.default_rng(2)
    net.biases = [rng.normal(size=b.shape) for b in net.biases]
    x = rng.normal(size=(4, 6))
    loss = lambda: ((net.forward(x)[-1] - x) ** 2).mean()
    acts = net.forward(x)
    for layer, (by_weight, by_bias) in enumerate(net.gradients(acts, 2 * (acts[-1] - x) / x.size)):
        for array, gradient in ((net.weights[layer], by_weight), (net.biases[layer], by_bias)):
            for at in np.ndindex(array.shape):
                array[at] += 1e-6
                up = loss()
                array[at] -= 2e-6
                assert abs((up - loss()) / 2e-6 - gradient[at]) < 1e-5
                array[at] += 1e-6


def test_new_normals_are_those_of_a_plain_loop():
    """Window by window, with the layers written out."""
    machine, v, w = online.NewNormals(12, start=300), beat(), 12
    net, mean = machine.trained(v[:300])
    x = v[:300].reshape(-1, w)
    want = ((net.forward(x - mean)[-1] + mean - x) ** 2).ravel().tolist()
    limit = np.quantile(want, 0.95)
    weights, biases, learned = net.weights, net.biases, 0
    for i in range(300, len(v) - w + 1, w):
        x = v[i : i + w]
        mean = 0.99 * mean + 0.01 * x.mean()
        acts, z = [x - mean], x - mean
        for j in range(6):
            z = weights[j].T @ z + biases[j]
            z = z * (z > 0) if j < 5 else z
            acts.append(z)
        error = z + mean - x
        want += (error**2).tolist()
        slope = np.array([2 * e / w if e * e < limit else 0.0 for e in error])
        learned += int((error**2 < limit).sum())
        for j in reversed(range(6)):
            back = weights[j] @ slope * (acts[j] > 0)
            weights[j] = weights[j] - 0.01 * np.outer(acts[j], slope)
            biases[j] = biases[j] - 0.01 * slope
            slope = back
    assert learned > 100 and np.allclose(online.batch_scores(machine, v), want)


@pytest.mark.parametrize("machine", MACHINES)
def test_streams_score_as_one_batch(spark, tmp_path, machine):
    v = {"a": beat(), "b": beat(seed=2)}
    rows = spark.createDataFrame([(s, i, float(x)) for s, y in v.items() for i, x in enumerate(y)], "series_id string, idx long, value double")
    for lo, hi in ((0, 350), (500, 700), (350, 500), (700, 900)):  # one part comes early
        rows.filter(F.col("idx").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = online.detect_stream(source, machine).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {s: {r.idx: r.score for r in spark.table("online").filter(F.col("series_id") == s).collect()} for s in v}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for s, y in v.items():
        want = online.batch_scores(machine, y)
        assert sorted(got[s]) == list(range(len(want))) and np.allclose([got[s][i] for i in range(len(want))], want)


def test_m2n2_by_name(spark):
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(beat())], "series_id string, idx long, value double")
    got = [r.score for r in detect(rows, "M2N2").orderBy("idx").collect()]
    assert len(got) == 900 and np.isfinite(got).all()
    short = detect(rows.filter("idx < 10"), "M2N2").collect()
    assert {r.error for r in short} == {"no window of 12 points to train on"}
