"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more component, so that all have the same length and the largest inner product is the smallest
distance.  Each is keyed by its nearest pivot and its distance to it; the distances of a pivot are cut into annuli of
about ``GROUP`` vectors.  A query looks into the annuli that could be nearest, in growing numbers; by the triangle
inequality an annulus can be left out when the query's distance to the pivot is further from the annulus than the
k-th best found so far.  The last step looks into all that are left, so the result is exact.

Annulus and query block (of about ``GROUP`` queries at most, of the same nearest pivot where it has so many, as those
want much the same annuli) make a group, and only the groups that queries want get rows of the index; annuli of more vectors, such as
repeated ones, are cut by a hash of the row.  The driver holds the pivots and the bounds of the annuli, whose number is
bounded by PIVOTS * RINGS.

Vectors that are null, or hold a null or a component that isn't finite, take no part; nor do those of another length
than the commonest (the larger of two as common), nor rows without an id.  Rows with the same id are rows of their own:
each is a query of its own, and a candidate of all others.  Ties go to the smaller id.  An empty table gives an empty
result; other columns are ignored.  Scores are exact; one beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, store

PIVOTS, RINGS, SAMPLE, GROUP = 32, 64, 4_096, 2_048
#: Sums of products up to here are exact in double precision.
EXACT = 1 << 53
#: Queries whose bounds to all annuli are held at once.
VISIT = 256
#: How many annuli a query looks into before all that the bounds leave.
FIRST_RINGS = 4


def integer_vectors(table: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id and v: each component x as floor(scale * x); stored, so that the numbers stay."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = table.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(finite)
    # As doubles, which hold any whole number that floor() leaves of one; from 2**53 on doubles have no other part.
    whole = lambda y: F.when(F.abs(y) < float(EXACT), F.floor(y).cast("double")).otherwise(y)
    good = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v"))
    good = store(good, "vectors")
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _augment(v: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def _slack(width: int, longest: float) -> float:
    """What rounding may add to a distance of vectors whose squares sum up to ``longest`` at most."""
    return float(np.sqrt(16 * np.finfo(float).eps * (width + 8) * max(longest, 1.0)))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Points of the sample far from each other, moved to the middle of what is nearest to them."""
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(4):
        of = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[of == i].mean(axis=0) if (of == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def build_index(vectors: DataFrame) -> tuple[DataFrame, pd.DataFrame, np.ndarray, float]:
    """Vectors with ring and part; the rings (pivot, ring, lo, hi, parts); the pivots; the square of the greatest length."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    longest = float(vectors.agg(F.max(norm)).first()[0] or 0.0)
    sample = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return vectors.select("row", "vec_id", "v", F.lit(0).alias("pivot"), F.lit(0).alias("ring"), F.lit(0).alias("part")), pd.DataFrame(), np.zeros((0, 1)), longest
    pivots = choose_pivots(_augment(np.stack(sample["v"].to_list()), longest))

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_augment(_matrix(batch.column("v")), longest), pivots)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], ["row", "vec_id", "v", "pivot", "dist"])

    located = cut(vectors.mapInArrow(locate, f"row long, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>, pivot int, dist double"))
    cuts = located.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)]).alias("q")).toPandas()
    inner = {}
    for pivot, n, q in zip(cuts["pivot"], cuts["n"], cuts["q"]):
        rings = min(RINGS, -(-int(n) // GROUP))
        inner[int(pivot)] = sorted({float(q[round(i * RINGS / rings) - 1]) for i in range(1, rings)})
    base = dict(zip(sorted(inner), np.cumsum([0] + [len(inner[p]) + 1 for p in sorted(inner)]).tolist()))

    @F.pandas_udf("int")
    def ring_of(pivot: pd.Series, dist: pd.Series) -> pd.Series:
        out, p = np.zeros(len(pivot), np.int32), pivot.to_numpy()
        for x in np.unique(p).tolist():
            out[p == x] = base[x] + np.searchsorted(inner[x], dist.to_numpy()[p == x], "left")
        return pd.Series(out)

    ringed = located.withColumn("ring", ring_of("pivot", "dist"))
    rings = ringed.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).toPandas().sort_values("ring")
    rings["parts"] = -(-rings["n"] // GROUP)
    # Which part of an annulus that is cut: by the row.
    pairs = [F.lit(int(x)) for r, parts in zip(rings["ring"], rings["parts"]) if parts > 1 for x in (r, parts)]
    parts = F.coalesce(F.create_map(*pairs)[F.col("ring")], F.lit(1)) if pairs else F.lit(1)
    return ringed.select("row", "vec_id", "v", "pivot", "ring", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part")), rings.reset_index(drop=True), pivots, longest


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, with integers of any size; ValueError beyond 64 bits."""
    out = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise ValueError("an inner product has more than 64 bits")
    return np.array(out, np.int64)


def _best(q: pa.Table, x: pa.Table, k: int, longest: float) -> pa.Table:
    """The k best of x for each query of a group; those of the k-th score are all weighed, the smaller id first.

    No product of vectors, and no part of one, exceeds the square of the greatest length.  Where that is more than
    double precision holds, all that may be among the best by what rounding adds is worked out again in integers.
    """
    ids, rows, own = x["vec_id"].to_numpy(), x["row"].to_numpy(), q["query_row"].to_numpy()
    found = []
    right = _matrix(x["v"].combine_chunks())
    unsure = 0.0 if longest < EXACT else 4 * longest * np.finfo(float).eps * (right.shape[1] + 2)
    for i in range(0, len(own), 512):
        part = q.slice(i, 512)
        left = _matrix(part["v"].combine_chunks())
        scores = left @ right.T
        scores[own[i : i + 512, None] == rows[None, :]] = -np.inf
        kth = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        row, col = np.nonzero((scores >= kth[:, None] - unsure) & np.isfinite(scores))
        score = exact_scores(left[row], right[col]) if unsure else scores[row, col].astype(np.int64)
        order = np.lexsort((ids[col], ~score, row))  # the complement is in reverse order
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, score = row[keep], col[keep], score[keep]
        found.append(pa.table({"query_row": own[i + row], "query_id": part["query_id"].take(pa.array(row)), "vec_id": x["vec_id"].take(pa.array(col)), "score": score}))
    return pa.concat_tables(found)


def query_blocks(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each pivot the first block of its queries and their number: pivots of few queries share a block of GROUP, those of more have several."""
    base, parts, block, filled = {}, {}, 0, 0
    for pivot, n in sorted(counts.items()):
        if filled and filled + n > GROUP:
            block, filled = block + 1, 0
        base[pivot], parts[pivot] = block, max(1, -(-n // GROUP))
        if n >= GROUP:
            block, filled = block + parts[pivot], 0
        else:
            filled += n
    return base, parts


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of each query."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    index, rings, pivots, longest = build_index(vectors)
    index = cut(index)
    result = f"query_row long, query_id {kind}, vec_id {kind}, score long"
    queries = index.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "pivot")
    base, parts = query_blocks({r["pivot"]: r["count"] for r in queries.groupBy("pivot").count().collect()})  # as many as pivots
    of_pivot = lambda figures, other: F.coalesce(F.create_map(*[F.lit(x) for item in figures.items() for x in item])[F.col("pivot")], F.lit(other)) if figures else F.lit(other)
    queries = cut(queries.withColumn("block", (of_pivot(base, 0) + F.pmod(F.xxhash64("query_row"), of_pivot(parts, 1))).cast("int")).drop("pivot"))
    slack = 3 * _slack(pivots.shape[1], longest)

    def visit(first: bool, kth: str | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(i, VISIT) for whole in batches for i in range(0, whole.num_rows, VISIT)):
                if not len(rings):
                    continue
                v = _matrix(batch.column("v"))
                to_pivot = _distances(_augment_query(v), pivots)[:, rings["pivot"].to_numpy()]
                bound = np.maximum(np.maximum(to_pivot - rings["hi"].to_numpy(), rings["lo"].to_numpy() - to_pivot), 0)
                order = np.argsort(bound, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
                if first:
                    wanted = place < FIRST_RINGS
                else:
                    score = batch.column(kth).to_numpy(zero_copy_only=False).astype(float)
                    # Distance of the k-th best so far, a little more for rounding; none so far: everything.
                    reach = np.where(np.isnan(score), np.inf, np.sqrt(np.maximum((v * v).sum(axis=1) + longest - 2 * score, 0))) * (1 + 1e-9) + slack
                    wanted = (place >= FIRST_RINGS) & (bound <= reach[:, None])
                row, ring = np.nonzero(wanted)
                parts = rings["parts"].to_numpy()[ring]
                row, ring = np.repeat(row, parts), np.repeat(ring, parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("query_row", "query_id", "v", "block")), pa.array(rings["ring"].to_numpy()[ring].astype(np.int32)), pa.array(part.astype(np.int32))], ["query_row", "query_id", "v", "block", "ring", "part"])

        return run

    def _augment_query(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.zeros((len(v), 1))])

    keys = ["ring", "part", "block"]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return _best(a, b, k, longest)
        return pa.table({"query_row": pa.array([], pa.int64()), "query_id": a["query_id"].slice(0, 0), "vec_id": b["vec_id"].slice(0, 0), "score": pa.array([], pa.int64())})

    def look(q: DataFrame, first: bool, kth: str | None) -> DataFrame:
        wanted = cut(q.mapInArrow(visit(first, kth), f"query_row long, query_id {kind}, v array<double>, block int, ring int, part int"))
        # Rows of the index only for the groups that queries want.
        asked = wanted.select(F.col("ring").alias("in_ring"), F.col("part").alias("in_part"), F.col("block").alias("for_block")).distinct()
        spread = index.drop("pivot").join(asked, (F.col("ring") == F.col("in_ring")) & (F.col("part") == F.col("in_part")))
        return wanted.groupBy(*keys).cogroup(spread.groupBy("in_ring", "in_part", "for_block")).applyInArrow(best, result)

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    near = cut(look(queries, True, None).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    kth = near.filter(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
    rest = look(queries.join(kth, "query_row", "left"), False, "kth")
    both = near.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
