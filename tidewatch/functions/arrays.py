"""Distances between arrays, and statistics of one array, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.operators.frames import mean_of, std_of


def lp_distance(a: Column, b: Column, p: int = 2) -> Column:
    """The p-norm of the difference over the length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), p)), F.lit(0.0), lambda s, v: s + v)
    return F.pow(total, 1 / p) / F.size(a)


def fourier_distance(a: Column, b: Column) -> Column:
    """The 2-norm of the difference of the Fourier transforms over the length: by Parseval, that of the values over sqrt(length)."""
    return lp_distance(a, b, 2) * F.sqrt(F.size(a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def autocorrelation(x: Column, lag: int) -> Column:
    """Unbiased: the mean product of deviations ``lag`` apart over the variance; null for a constant."""
    mean = mean_of(x)
    n = F.size(x)
    products = F.zip_with(F.slice(x, F.lit(1), n - lag), F.slice(x, F.lit(lag + 1), n - lag), lambda a, b: (a - mean) * (b - mean))
    var = F.pow(std_of(x, 0), 2)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) / (n - lag) / F.when(var > 0, var)


def moment(x: Column, k: int) -> Column:
    mean = mean_of(x)
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(k))) / F.size(x)


def skewness(x: Column) -> Column:
    m2 = moment(x, 2)
    return moment(x, 3) / F.when(m2 > 0, F.pow(m2, 1.5))


def kurtosis(x: Column) -> Column:
    """Excess kurtosis; null for a constant."""
    m2 = moment(x, 2)
    return moment(x, 4) / F.when(m2 > 0, m2 * m2) - 3


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def expected_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among n points (the constant is Euler's, a fixed value)."""
    return F.when(n > 2, 2.0 * (F.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n).when(n == 2, 1.0).otherwise(0.0)


def erf(x: Column) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz and Stegun (fixed values); off by 1.5e-7 at most."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))
