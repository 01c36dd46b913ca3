"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut


def _least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """u and m, the least of u and those linked with it: of all (large star) or of the smaller ones (small star)."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        seen = seen.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return seen.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in the edges (columns a and b); loops and repeated edges do no harm.

    Edges always point from the larger to the smaller id.  Large-star steps link the larger neighbours of an id to its
    least neighbour, small-star steps the smaller ones; both keep the number of edges, until every edge points to
    a root.  The least neighbours are written out before they are joined, so that a join of many edges of one id can be
    split.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # read twice, but made once
    now, loops = edges.filter("a <> b"), edges.filter("a = b")
    mark = None
    while True:
        least = cut(_least(now, both_ways=True))
        # For u and each larger neighbour v: v - m(u).
        large = now.join(least, now["b"] == least["u"]).select(now["a"].alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large)
        least = cut(_least(large, both_ways=False))
        # For u and each smaller neighbour v: v - m(u); and u - m(u).
        small = large.join(least, large["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    done = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    alone = loops.select(F.col("a").alias("id")).distinct().join(done, "id", "left_anti")
    return done.unionByName(alone.select("id", F.col("id").alias("component")))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members of a small group, the least member that the pairs (i, j) lead to."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
