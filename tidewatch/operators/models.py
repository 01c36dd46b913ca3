"""Models fitted on all points of many series at once, and points scored by them, both in tasks of bounded size.

Points are rows (series_id, idx, v).  A fit reduces what a task has read of a series to sums or to a sample of bounded
size; only these meet in one task for the series, where they are added as they stream by.  The model comes back as a
row for each series, in a plain format, and meets the points in groups of a series and a bucket of indices, so a long
series is fitted and scored by many tasks.

A detector is a ``Kind``: how its models are fitted, and how a model scores points.  Both apart give model tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.plain import pack, unpack
from tidewatch.operators.segments import bucket
from tidewatch.sources.lineage import materialise

#: Points of a series in the sample that starts or makes a model.
POOL = 4_096
#: Series that a task holds sums of before it passes them on.
HELD = 256

Model = Any
MODELS = "series_id string, model binary"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _pack(rows: list[tuple[str, Model]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([pack(m) for _, m in rows], pa.binary())], ["series_id", "model"])


def fit(points: DataFrame, reduce: Callable[[np.ndarray, np.ndarray], Model], add: Callable[[Model, Model], Model], finish: Callable[[Model], Model]) -> DataFrame:
    """series_id and model.  reduce(idx, v) of some points and add() of two results; finish() makes the model of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Model] = {}
        for batch in batches:
            names = np.asarray(batch.column("series_id").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                own = pa.array(np.flatnonzero(names == name))
                part = reduce(batch.column("idx").take(own).to_numpy(), matrix(batch.column("v").take(own)))
                held[name] = add(held[name], part) if name in held else part
            if len(held) > HELD:
                yield _pack([*held.items()])
                held = {}
        if held:
            yield _pack([*held.items()])

    return _merged(points.select("series_id", "idx", "v").mapInArrow(run, MODELS), add, finish)


def _merged(parts: DataFrame, add: Callable[[Model, Model], Model], finish: Callable[[Model], Model]) -> DataFrame:
    """One model of each series from its parts, which are read one by one: a task holds a total and a part, however many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for batch in batches:
            for own, part in zip(batch.column("series_id"), batch.column("model")):
                part = unpack(part.as_py())
                if total is not None and own.as_py() == name:
                    total = add(total, part)
                    continue
                if total is not None:
                    yield _pack([(name, finish(total))])
                name, total = own.as_py(), part
        if total is not None:
            yield _pack([(name, finish(total))])

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "series_id").sortWithinPartitions("series_id").mapInArrow(run, MODELS)


def _met(points: DataFrame, models: DataFrame, function: Callable[[Model, np.ndarray, np.ndarray, str], pa.Table], schema: str) -> DataFrame:
    """function(model, idx, v, series) for each series and bucket of indices."""
    dealt = points.select("series_id", "idx", "v", bucket().alias("_b"))
    ends = dealt.groupBy("series_id").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    spread = models.join(ends, "series_id").select(F.col("series_id").alias("_series"), "model", F.explode(F.sequence("_lo", "_hi")).alias("_c"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return function(unpack(b["model"][0].as_py()), a["idx"].to_numpy(), matrix(a["v"]), a["series_id"][0].as_py())
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table({n: pa.array([], kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))})

    # By a number, so that small tables aren't put in one task: it is the computation that counts.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = dealt.repartition(tasks, "series_id", "_b"), spread.repartition(tasks, "_series", "_c")
    return left.groupBy("series_id", "_b").cogroup(right.groupBy("_series", "_c")).applyInArrow(run, schema)


def score(points: DataFrame, models: DataFrame, how: Callable[[Model, np.ndarray], np.ndarray]) -> DataFrame:
    """series_id, idx and score of every point by its series' model."""

    def run(model: Model, idx: np.ndarray, v: np.ndarray, series: str) -> pa.Table:
        return pa.table({"series_id": pa.array([series] * len(idx), pa.string()), "idx": idx, "score": np.asarray(how(model, v), float)})

    return _met(points, models, run, "series_id string, idx long, score double")


def refit(points: DataFrame, models: DataFrame, reduce: Callable[[Model, np.ndarray], Model], add: Callable[[Model, Model], Model], finish: Callable[[Model], Model]) -> DataFrame:
    """Models made of sums over all points that reduce() takes with the models before."""

    def run(model: Model, idx: np.ndarray, v: np.ndarray, series: str) -> pa.Table:
        return pa.table({"series_id": [series], "model": pa.array([pack(reduce(model, v))], pa.binary())})

    return _merged(_met(points, models, run, MODELS), add, finish)


def _with(models: DataFrame, numbers: DataFrame) -> DataFrame:
    """The models (tuples) with a number of each series (its second column) behind."""
    column = numbers.columns[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pack([(s, (*unpack(m), x)) for s, m, x in zip(*(batch.column(c).to_pylist() for c in ("series_id", "model", column)))])

    return models.join(numbers, "series_id").select("series_id", "model", column).mapInArrow(run, MODELS)


# Sums and samples


def _moments(_: np.ndarray, v: np.ndarray) -> Model:
    return len(v), v.sum(axis=0), v.T @ v


def _add(a: Model, b: Model) -> Model:
    return tuple(x + y for x, y in zip(a, b))


def _hash(idx: np.ndarray) -> np.ndarray:
    x = idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _least(keys: np.ndarray, v: np.ndarray, most: int) -> Model:
    keep = np.argsort(keys, kind="stable")[:most]
    return keys[keep], v[keep]


def pooled(points: DataFrame, finish: Callable[[Model], Model], pool: int) -> DataFrame:
    """Models of a sample of each series: the ``pool`` points whose index has the least hashes, or all of them."""
    return fit(points, lambda idx, v: _least(_hash(idx), v, pool), lambda a, b: _least(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), pool), finish)


@dataclass(frozen=True)
class Kind:
    """fit(points, **params) gives models (series_id, model); how(model, v, **params) the scores of points."""

    fit: Callable[..., DataFrame]
    how: Callable[..., np.ndarray]
    #: Parameters that scoring takes too.
    both: tuple[str, ...] = ()

    def score(self, points: DataFrame, models: DataFrame, **params: Any) -> DataFrame:
        return score(points, models, partial(self.how, **{k: v for k, v in params.items() if k in self.both}))

    def __call__(self, points: DataFrame, train: DataFrame | None = None, **params: Any) -> DataFrame:
        return self.score(points, self.fit(train if train is not None else points, **params), **params)


# Principal components


def principal_models(points: DataFrame, keep: int | float | None = None) -> DataFrame:
    """Columns that vary, means and deviations of all, variances along the components and their vectors (a column each).

    The covariance is a sum of outer products over all points.  Columns are standardised, constant ones dropped; a
    vector's largest loading is positive.
    """

    def finish(total: Model) -> Model:
        n, s, ss = total
        mean = s / n
        cov = ss / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        own = np.flatnonzero(std > 1e-9 * np.maximum(np.abs(mean), 1))
        values, vectors = np.linalg.eigh(cov[np.ix_(own, own)] / np.outer(std[own], std[own]) * n / max(n - 1, 1)) if len(own) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(values)[::-1]
        if isinstance(keep, float):  # as many as explain more than this share of the variance
            share = np.cumsum(np.maximum(values[order], 0))
            order = order[: int(np.searchsorted(share, keep * share[-1], "right")) + 1] if len(order) else order
        else:
            order = order[: keep or min(n, len(own))]
        values, vectors = np.maximum(values[order], 1e-12), vectors[:, order]
        if vectors.size:
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        return own, mean, std, values, vectors

    return fit(points, _moments, _add, finish)


def principal_scores(model: Model, v: np.ndarray) -> np.ndarray:
    """Sum over components of the distance from the point to the component's vector, over the share of variance it explains."""
    own, mean, std, values, vectors = model
    if not len(own):
        return np.zeros(len(v))
    x = (v[:, own] - mean[own]) / std[own]
    away = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + 1 - 2 * x @ vectors, 0))
    return (away / (values / values.sum())).sum(axis=1)


principal = Kind(principal_models, principal_scores)


# Isolation forests


def expected_depth(n: np.ndarray) -> np.ndarray:
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1.0, 1)) + 0.5772156649) - 2 * (n - 1.0) / np.maximum(n, 1), (n == 2) * 1.0)


def _tree(own: np.ndarray, pool: np.ndarray, height: int, extended: bool, rng: np.random.Generator) -> Model:
    """Nodes of one tree: a normal (or a column) and a cut each, children, and the depth that a leaf stands for."""
    normals, cuts, children, depths = [], [], [], []

    def grow(own: np.ndarray, level: int) -> int:
        at = len(cuts)
        normals.append(None)
        cuts.append(0.0)
        children.append((-1, -1))
        depths.append(level + float(expected_depth(np.array(float(len(own))))))
        spread = own[:, pool].max(axis=0) - own[:, pool].min(axis=0) if len(own) else np.zeros(1)
        if level < height and len(own) > 1 and spread.max() > 0:
            if extended:
                normals[at] = rng.normal(size=own.shape[1])
                cuts[at] = float(rng.uniform(own.min(axis=0), own.max(axis=0)) @ normals[at])
                side = own @ normals[at] < cuts[at]
            else:
                normals[at] = int(rng.choice(pool[spread > 0]))
                cuts[at] = float(rng.uniform(own[:, normals[at]].min(), own[:, normals[at]].max()))
                side = own[:, normals[at]] < cuts[at]
            children[at] = grow(own[side], level + 1), grow(own[~side], level + 1)
        return at

    grow(own, 0)
    leaf = np.zeros(own.shape[1]) if extended else -1
    return np.array([leaf if n is None else n for n in normals]), np.array(cuts), np.array(children), np.array(depths)


def _depths(tree: Model, v: np.ndarray) -> np.ndarray:
    normals, cuts, children, depths = tree
    out = np.zeros(len(v))
    stack = [(0, np.arange(len(v)))]
    while stack:
        at, rows = stack.pop()
        if not len(rows):
            continue
        if children[at, 0] < 0:
            out[rows] = depths[at]
            continue
        side = (v[rows] @ normals[at] if normals.ndim == 2 else v[rows, normals[at]]) < cuts[at]
        stack += [(children[at, 0], rows[side]), (children[at, 1], rows[~side])]
    return out


def forests(points: DataFrame, trees: int = 100, sample: int = 256, extended: bool = False, columns: int | float | None = None, seed: int = 0, pool: int | None = None) -> DataFrame:
    """Trees of random splits: of one column, or (extended) by random hyperplanes; and the depth expected of their samples.

    Each tree grows on ``sample`` points, drawn from a sample of at most ``pool`` points of the series.
    """

    def finish(total: Model) -> Model:
        x, rng, forest = total[1], np.random.default_rng(seed), []
        size = min(sample, len(x))
        for _ in range(trees):
            some = max(1, int(columns * x.shape[1])) if isinstance(columns, float) else columns  # a share of them
            own = rng.choice(x.shape[1], min(some, x.shape[1]), replace=False) if some else np.arange(x.shape[1])
            forest.append(_tree(x[rng.choice(len(x), size, replace=False)], own, int(np.ceil(np.log2(max(size, 2)))), extended, rng))
        return forest, max(float(expected_depth(np.array(float(size)))), 1e-12)

    return pooled(points, finish, pool or POOL)


def isolation_scores(model: Model, v: np.ndarray) -> np.ndarray:
    """2 ** -(mean depth / expected depth)."""
    forest, expected = model
    return 2 ** (-np.mean([_depths(t, v) for t in forest], axis=0) / expected)


isolation = Kind(forests, isolation_scores)


# Clusters


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1), 0)
    return d.argmin(axis=1), d


def _lloyd(v: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        of, _ = _nearest(v, centres)
        new = np.stack([v[of == i].mean(axis=0) if (of == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def centres_of(points: DataFrame, clusters: int = 8, seed: int = 0, rounds: int = 3, pool: int | None = None) -> DataFrame:
    """series_id and model (centres): started far apart and settled on a sample of at most ``pool`` points, then moved over all points.

    Each of the ``rounds`` over all points is a sum for each cluster; a series of no more than ``pool`` points has settled before.
    """
    own = materialise(points.select("series_id", "idx", "v"))

    def start(total: Model) -> Model:
        x, rng = total[1], np.random.default_rng(seed)
        centres = [x[rng.integers(len(x))]]
        near = ((x - centres[0]) ** 2).sum(axis=1)
        while len(centres) < min(clusters, len(x)) and near.sum() > 0:
            centres.append(x[rng.choice(len(x), p=near / near.sum())])
            near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
        return _lloyd(x, np.stack(centres), 50)

    def sums(centres: Model, v: np.ndarray) -> Model:
        of, _ = _nearest(v, centres)
        total = np.zeros_like(centres)
        np.add.at(total, of, v)
        return total, np.bincount(of, minlength=len(centres)), centres

    def add(a: Model, b: Model) -> Model:
        return a[0] + b[0], a[1] + b[1], a[2]

    def move(total: Model) -> Model:
        s, n, before = total
        return np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], before)

    pool = pool or POOL
    models = pooled(own, start, pool)
    longest = own.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(rounds if longest > pool else 0):  # otherwise the sample was all points
        models = refit(own, materialise(models), sums, add, move)
    return materialise(models)


def centre_distances(centres: Model, v: np.ndarray) -> np.ndarray:
    """The distance to the nearest centre."""
    return np.sqrt(_nearest(v, centres)[1].min(axis=1))


centre_distance = Kind(centres_of, centre_distances)


def cluster_models(points: DataFrame, clusters: int = 8, alpha: float = 0.9, beta: float = 5.0, weighted: bool = False, seed: int = 0, pool: int | None = None) -> DataFrame:
    """Centres, their sizes, and which are large.

    Clusters by size are split into large and small ones, where both the coverage alpha and the jump beta are met, or
    else the coverage, or else the jump.
    """

    def counts(centres: Model, v: np.ndarray) -> Model:
        return np.bincount(_nearest(v, centres)[0], minlength=len(centres)), centres

    def mark(total: Model) -> Model:
        size, centres = total
        order = np.argsort(-size, kind="stable")
        kept = size[order]
        upto, jump = np.cumsum(kept) >= alpha * kept.sum(), np.append(kept[:-1] >= beta * np.maximum(kept[1:], 1), False)
        first = next((np.flatnonzero(x) for x in (upto & jump, upto, jump) if x.any()), [len(kept) - 1])[0]
        large = np.zeros(len(size), bool)
        large[order[: first + 1]] = True
        return centres, size, large

    settled = centres_of(points, clusters=clusters, seed=seed, pool=pool)
    return refit(points, settled, counts, lambda a, b: (a[0] + b[0], a[1]), mark)


def cluster_scores(model: Model, v: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Cluster-based outlier factor: of points of large clusters the distance to their own centre, of others that to the nearest large one."""
    centres, size, large = model
    of, d = _nearest(v, centres)
    away = np.sqrt(np.where(large[of], d[np.arange(len(v)), of], np.where(large, d, np.inf).min(axis=1)))
    return away * size[of] if weighted else away


cluster_factor = Kind(cluster_models, cluster_scores, ("weighted",))


# Robust covariance


def mahalanobis_scores(model: Model, v: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances."""
    mean, inverse = model[0], model[1]
    return np.einsum("ij,ij->i", (v - mean) @ inverse, v - mean)


def covariances(points: DataFrame, support: float | None = None, starts: int = 10, rounds: int = 2, seed: int = 0, pool: int | None = None) -> DataFrame:
    """Mean and inverse covariance of the half of the points with the least covariance determinant found.

    Subsets are tried and concentrated on a sample of at most ``pool`` points; the best is then concentrated ``rounds`` times
    over all points, by the distance that half of them keep (exact to one in 10,000 points).
    """
    distances = mahalanobis_scores

    def of(n: int, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / n
        return mean, ss / n - np.outer(mean, mean) + 1e-9 * np.eye(len(s))

    def start(total: Model) -> Model:
        x, rng, best = total[1], np.random.default_rng(seed), None
        n, d = x.shape
        h = min(n, int(support * n) if support else (n + d + 1) // 2)
        for _ in range(starts):
            rows = rng.permutation(n)[: d + 1]
            for _ in range(20):
                mean, cov = of(len(rows), x[rows].sum(axis=0), x[rows].T @ x[rows])
                inverse = np.linalg.inv(cov)
                now = np.argsort(distances((mean, inverse), x), kind="stable")[:h]
                if set(now.tolist()) == set(rows.tolist()):
                    break
                rows = now
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[0]:
                best = det, mean, inverse
        return best[1:]

    own = materialise(points.select("series_id", "idx", "v"))
    pool = pool or POOL
    models = materialise(pooled(own, start, pool))
    longest = own.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(rounds if longest > pool else 0):
        far = score(own, models, distances)
        limits = far.groupBy("series_id").agg(F.percentile_approx("score", support or 0.5, 10_000).alias("limit"))

        def sums(model: Model, v: np.ndarray) -> Model:
            kept = v[distances(model, v) <= model[2]]
            return len(kept), kept.sum(axis=0), kept.T @ kept

        def concentrate(total: Model) -> Model:
            mean, cov = of(max(total[0], 1), total[1], total[2])
            return mean, np.linalg.inv(cov)

        models = materialise(refit(own, _with(models, limits), sums, _add, concentrate))
    return models


covariance_distance = Kind(covariances, mahalanobis_scores)


# Linear maps


def linear_kind(sides: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], last: bool = False, scale: Callable[[np.ndarray], np.ndarray] | None = None) -> Kind:
    """Squared errors of a linear map from sides(v)[0] (and a constant) to sides(v)[1]: of all columns on average, or of the last.

    The map comes from sums of products over the training points.
    """

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = sides(v)
        return np.hstack([a, np.ones((len(a), 1))]), b

    def maps(points: DataFrame, ridge: float = 1e-2) -> DataFrame:
        def products(_: np.ndarray, v: np.ndarray) -> Model:
            a, b = both(v)
            return a.T @ a, a.T @ b

        return fit(points, products, _add, lambda total: np.linalg.solve(total[0] + ridge * np.eye(len(total[0])), total[1]))

    def errors(model: Model, v: np.ndarray) -> np.ndarray:
        a, b = both(v)
        off = (a @ model - b) * (scale(v)[:, None] if scale else 1.0)
        return off[:, -1] ** 2 if last else (off**2).mean(axis=1)

    return Kind(maps, errors)
