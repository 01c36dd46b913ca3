"""Means and deviations that don't depend on the order in which rows are added up.

Values of at most four decimal places and under 2 ** 31 / 10,000 in size are summed up as whole numbers, so equal groups
have equal figures, whatever task or engine adds them first; a group with any other value has Spark's own average.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, LIMIT = 10_000, 1 << 31


def _units(column: str) -> Column:
    """Ten-thousandths, null for a value that isn't a whole number of them."""
    value = F.col(column).cast("double")
    whole = F.when(F.abs(value) < LIMIT / SCALE, F.rint(value * SCALE).cast("long"))
    return F.when(whole / F.lit(float(SCALE)) == value, whole)


def mean(column: str) -> Column:
    units = _units(column)
    return F.when(F.count(units) == F.count(column), F.sum(units) / F.nullif(F.count(units) * SCALE, F.lit(0))).otherwise(F.avg(column))


def deviation(column: str, ddof: int = 0) -> Column:
    """The root of (n * sum of squares - square of the sum) / (n * (n - ddof)), its numerator exact: n and units are under 2 ** 31, so it has 38 digits at most."""
    units = _units(column)
    whole = lambda c: c.cast("decimal(38,0)")
    # Squares in two parts, so that either is summed up as a long.
    square, low = units * units, (1 << 31) - 1
    squares = whole(F.sum(F.shiftright(square, 31))) * whole(F.lit(low + 1)) + whole(F.sum(square.bitwiseAND(F.lit(low))))
    n, total = F.count(units), whole(F.sum(units))
    spread = (whole(n) * squares - total * total).cast("double")
    pairs = n.cast("double") * (n - ddof)
    exact = F.sqrt(spread / F.when(pairs > 0, pairs)) / SCALE
    return F.when(n == F.count(column), exact).otherwise(F.stddev_samp(column) if ddof else F.stddev_pop(column))
