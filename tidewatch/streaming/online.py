"""Detectors that go on learning from a stream, with all they know in the state of the series.

The state holds what has come but isn't scored yet and the model, in the plain format of models.  Points are taken in
order of idx, from 0: those that come early wait, those that come again are left out.  What is scored depends on the
points alone, not on how they are cut into micro-batches.  A point is scored when its chunk is complete.

Such a stream needs the state store that keeps values of any size: ``state_store`` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewatch.operators.kernels import aligned, nearest_in, shape_correlation, shapes
from tidewatch.operators.plain import pack, unpack

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _unit(x: np.ndarray) -> float:
    return (x - x.min()) / (x.max() - x.min() + 1e-7) + 1


@dataclass(frozen=True)
class OnlineShapes:
    """k-shape clusters of sub-sequences (length 4 * width, one every 1.5 * width), batch by batch.

    The first ``start`` points are clustered, then ``batch`` points at a time.  A batch's clusters are merged with those
    nearer than their own mean distance, or else added: the number of clusters has no limit.  Of a cluster the state
    has its centre, the sum of outer products of its aligned members (from which a merged centre is made), how many
    they are, their mean distance (of each to the centre of its time) and where the last one begins; members
    themselves go, but for the tail that later sub-sequences need.  Scores are distances to the centres, weighted by
    frequency, centrality and age, as a running mean less their level.
    """

    width: int = 24
    k: int = 6
    start: int = 500
    batch: int = 200
    alpha: float = 0.5
    seed: int = 0

    def begin(self) -> tuple:
        m = 4 * self.width
        return np.zeros(0), 0, 0, 0, np.zeros((0, m)), np.zeros((0, m, m)), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), None, None

    def feed(self, state: tuple, values: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The state behind the values, and the scores of all points of chunks that are complete now."""
        held, base, now, following, centres, outer, far, size, last, weight, level, spread = state
        centres, outer = [*centres], [*outer]
        far, size, last, weight = far.copy(), size.copy(), last.copy(), weight.copy()
        held = np.concatenate([held, values])
        length, stride, scores = 4 * self.width, max(int(1.5 * self.width), 1), []
        distance = lambda x, c: 1 - shape_correlation(x, c)[0]
        while base + len(held) >= now + (chunk := self.batch if now else self.start):
            starts = np.arange(following, now + chunk - length + 1, stride)
            if len(starts):
                subs = np.stack([held[i - base : i - base + length] for i in starts.tolist()])
                of, found = shapes(subs, min(self.k, len(starts)), self.seed)
                known, merge = len(centres), {}
                for i, c in enumerate(found):
                    own = np.flatnonzero(of == i)
                    if not len(own):
                        continue
                    near = distance(np.stack(centres[:known]), c) if known else np.zeros(0)
                    if known and near.min() < far[int(near.argmin())]:
                        merge.setdefault(int(near.argmin()), []).extend(own.tolist())
                        continue
                    moved = aligned(subs[own], c)
                    centres.append(c)
                    outer.append(moved.T @ moved)
                    far, size, last = np.append(far, distance(subs[own], c).mean()), np.append(size, float(len(own))), np.append(last, float(starts[own[-1]]))
                for i, new in merge.items():
                    moved = aligned(subs[new], centres[i])
                    outer[i] = outer[i] + moved.T @ moved
                    middle = np.eye(length) - 1 / length
                    c = np.linalg.eigh(middle @ outer[i] @ middle)[1][:, -1]
                    if np.linalg.norm(moved + c, axis=1).sum() < np.linalg.norm(moved - c, axis=1).sum():
                        c = -c
                    far[i] = (far[i] * size[i] + distance(subs[new], centres[i]).sum()) / (size[i] + len(new))
                    size[i] += len(new)
                    last[i] = max(last[i], float(starts[max(new)]))
                    centres[i] = (c - c.mean()) / max(c.std(ddof=1), 1e-12)
                following = int(starts[-1]) + stride
            own = held[now - base : now - base + chunk]
            now += chunk
            if centres:
                all_centres = np.stack(centres)
                central = np.array([distance(all_centres, c).sum() for c in centres])
                fresh = _unit(size) ** 2 / _unit(central)
                weight = np.concatenate([weight, fresh[len(weight) :]])
                weight = (1 - self.alpha) * weight + self.alpha * fresh / (1 + np.maximum(now - last - self.batch, 0))
                joined = sum(w * nearest_in(own, c, self.width) for w, c in zip(weight, centres)) / weight.sum()
                mean = np.convolve(np.pad(joined, (0, self.width - 1), "edge"), np.full(self.width, 1 / self.width), "valid")
                mean = np.pad(mean, (self.width - 1, 0), "edge")
                level = mean.mean() if level is None else (1 - self.alpha) * level + self.alpha * mean.mean()
                spread = mean.std() if spread is None else (1 - self.alpha) * spread + self.alpha * mean.std()
                scores.append((mean - level) / max(spread, 1e-12))
            else:  # no sub-sequence fits into what has come so far
                scores.append(np.zeros(chunk))
            keep = min(following, now)
            held, base = held[keep - base :], keep
        m = 4 * self.width
        new = held, base, now, following, np.array(centres).reshape(-1, m), np.array(outer).reshape(-1, m, m), far, size, last, weight, level, spread
        return new, np.concatenate(scores) if scores else np.zeros(0)


class Network:
    """A chain of linear layers with rectifiers between them, and steps down the gradient of a weighted mean square."""

    def __init__(self, weights: list[np.ndarray], biases: list[np.ndarray]):
        self.weights, self.biases = weights, biases

    @classmethod
    def of_sizes(cls, sizes: list[int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            x = np.maximum(x, 0) if i + 1 < len(self.weights) else x
            acts.append(x)
        return acts

    def gradients(self, acts: list[np.ndarray], slope: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of weights and biases of each layer, for the slope of the loss at the output."""
        out = []
        for i in reversed(range(len(self.weights))):
            out.append((acts[i].T @ slope, slope.sum(axis=0)))
            slope = slope @ self.weights[i].T * (acts[i] > 0)
        return out[::-1]

    def step(self, gradients: list[tuple[np.ndarray, np.ndarray]], rate: float) -> None:
        self.weights = [w - rate * g for w, (g, _) in zip(self.weights, gradients)]
        self.biases = [b - rate * g for b, (_, g) in zip(self.biases, gradients)]


@dataclass(frozen=True)
class NewNormals:
    """A small network that rebuilds windows less a moving mean, and goes on learning from what it takes for normal.

    It is trained on the first ``start`` points; the ``quantile`` of the squared errors there is the limit.  Of every
    window that follows, the mean moves first (by 1 - gamma), then its points are scored by their squared errors, then
    the network makes a step for those under the limit.
    """

    width: int = 12
    latent: int = 8
    start: int = 600
    epochs: int = 30
    rate: float = 0.05
    online_rate: float = 0.01
    gamma: float = 0.99
    quantile: float = 0.95
    seed: int = 0

    def begin(self) -> tuple:
        return np.zeros(0), 0, 0.0, 0.0, (), ()

    def trained(self, values: np.ndarray) -> tuple[Network, float]:
        """The network of the windows of the training part, and their mean."""
        w, mean = self.width, float(values.mean())
        net = Network.of_sizes([w, max(w // 2, 1), max(w // 4, 1), self.latent, max(w // 4, 1), max(w // 2, 1), w], self.seed)
        x = values[: len(values) // w * w].reshape(-1, w) - mean
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
                acts = net.forward(x[rows])
                net.step(net.gradients(acts, np.clip(2 * (acts[-1] - x[rows]) / x[rows].size, -1, 1)), self.rate)
        return net, mean

    def adapt(self, net: Network, mean: float, limit: float, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The moved mean and the scores of a window; the network has learned from it."""
        mean += (1 - self.gamma) * (float(x.mean()) - mean)
        acts = net.forward((x - mean)[None])
        off = acts[-1][0] + mean - x
        net.step(net.gradients(acts, (2 * off * (off**2 < limit) / self.width)[None]), self.online_rate)
        return mean, off**2

    def feed(self, state: tuple, values: np.ndarray) -> tuple[tuple, np.ndarray]:
        held, done, mean, limit, weights, biases = state
        held, scores, w = np.concatenate([held, values]), [], self.width
        net = Network([*weights], [*biases])
        first = max(self.start // w, 1) * w
        if not done and len(held) >= first:
            net, mean = self.trained(held[:first])
            x = held[:first].reshape(-1, w)
            errors = (net.forward(x - mean)[-1] + mean - x) ** 2
            limit = float(np.quantile(errors, self.quantile))
            scores.append(errors.ravel())
            held, done = held[first:], first
        while done and len(held) >= w:
            mean, own = self.adapt(net, mean, limit, held[:w])
            scores.append(own)
            held, done = held[w:], done + w
        return (held, done, mean, limit, tuple(net.weights), tuple(net.biases)), np.concatenate(scores) if scores else np.zeros(0)


def in_order(machine: Any, state: tuple | None, idx: np.ndarray, values: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Feed a machine the points that follow those it had; the new state, and idx and scores of the points that are scored now."""
    following, scored, early, waiting, own = state or (0, 0, np.zeros(0, np.int64), np.zeros(0), machine.begin())
    idx, at = np.unique(np.concatenate([early, idx.astype(np.int64)]), return_index=True)
    values = np.concatenate([waiting, values.astype(float)])[at]
    idx, values = idx[keep := idx >= following], values[keep]
    n = int((idx == following + np.arange(len(idx))).sum())  # ascending, so a gap ends the run for good
    own, scores = machine.feed(own, values[:n])
    new = following + n, scored + len(scores), idx[n:], values[n:], own
    return new, scored + np.arange(len(scores)), scores


class InOrder(StatefulProcessor):
    """Keeps a machine for each series."""

    def __init__(self, machine: Any):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", StructType([StructField("model", BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        state = unpack(bytes(self.state.get()[0])) if self.state.exists() else None
        state, idx, scores = in_order(self.machine, state, pdf["idx"].to_numpy(), pdf["value"].to_numpy())
        self.state.update((pack(state),))
        if len(idx):
            yield pd.DataFrame({"series_id": key[0], "idx": idx, "score": scores})

    def close(self) -> None:
        pass


def detect_stream(points: DataFrame, machine: Any) -> DataFrame:
    """series_id, idx and score of a stream of points (series_id, idx, value), by a machine such as OnlineShapes() or NewNormals()."""
    state_store(points.sparkSession)
    rows = points.select("series_id", "idx", "value").groupBy("series_id")
    return rows.transformWithStateInPandas(InOrder(machine), "series_id string, idx long, score double", "append", "none")


def batch_scores(machine: Any, values: np.ndarray) -> np.ndarray:
    """What the stream gives for a series, all at once."""
    return machine.feed(machine.begin(), np.asarray(values, float))[1]


def adapted_scores(v: np.ndarray, limit: int, width: int = 12, **params: Any) -> np.ndarray:
    """``NewNormals`` trained on the first ``limit`` points of a series; what is left over behind the last window has the score of the point before."""
    scores = batch_scores(NewNormals(width, start=limit, **params), v)
    if not len(scores):
        raise ValueError(f"no window of {width} points to train on")
    return np.pad(scores, (0, len(v) - len(scores)), "edge")
