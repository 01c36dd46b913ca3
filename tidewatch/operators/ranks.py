"""Ranks and running sums over long groups, by many tasks.

Values of a group are dealt to PARTS ranges between its (approximate) percentiles.  In a range they are put in order by
one task; over a whole group only the ranges' sums are, which are at most PARTS rows.  The ranges decide where work is
done, not what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values of a group.
PARTS = 64


def from_the_top(steps: DataFrame, keys: list[str], value: str, sums: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows of distinct values of groups, with sums: for a column, its name summed over values from the greatest down to each, and its name summed over the group."""
    cuts = steps.groupBy(*keys).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 1_000).alias("_cuts"))
    dealt = steps.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = dealt.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    group = Window.partitionBy(*keys)
    above = group.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in sums), *(F.sum(f"_{c}").over(group).alias(whole) for c, (_, whole) in sums.items()))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(bases, [*keys, "_part"])
    return out.select(*steps.columns, *((F.col(f"_above_{c}") + F.sum(c).over(inside)).alias(at) for c, (at, _) in sums.items()), *(whole for _, whole in sums.values()))


def at_or_below(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each distinct value of a group: how many values are at or below it, at or above it, and in the group (below, above, n)."""
    steps = values.groupBy(*keys, value).agg(F.count("*").alias("_own"))
    return from_the_top(steps, keys, value, {"_own": ("above", "n")}).select(*keys, value, (F.col("n") - F.col("above") + F.col("_own")).alias("below"), "above", "n")
