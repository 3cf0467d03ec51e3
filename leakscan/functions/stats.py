"""Intervals, tests and the privacy accountant as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan import dims as D


def band(x: Column) -> Column:
    return F.when(x < D.LOW, "Low").when(x < D.HIGH, "Medium").otherwise("High")


def wilson(k: Column, n: Column, z: float = 1.96, clamp: bool = False) -> tuple[Column, Column]:
    """Interval of k successes in n; null (clamped: 0, 0) for n = 0."""
    m, p = n.cast("double"), k / n.cast("double")
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (mid - half) / (1 + z * z / m), (mid + half) / (1 + z * z / m)
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0 if clamp else None), F.when(n > 0, high).otherwise(0.0 if clamp else None)


def pooled_z(p1: Column, p2: Column, n1: Column, n2: Column) -> Column:
    p = (p1 * n1 + p2 * n2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(se > 0, (p1 - p2) / F.nullif(se, F.lit(0.0))).otherwise(0.0)


def two_sided_p(z: Column) -> Column:
    """2 * (1 - normal distribution at |z|), by a continued error-function fit; error below 1.5e-7."""
    # fixed values: coefficients of the rational approximation of erf
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def sign_test_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p at 1/2 of the smaller of b and c; 1 for no pairs. Terms by recurrence, from 2^-n on, in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms))


def epsilon(steps: Column, q: Column, sigma: Column, delta: float = 1e-5) -> Column:
    """Smallest over orders 2 to 255 of the subsampled bound; infinite without noise."""
    each = lambda a: steps * q * q * a / (2 * sigma * sigma) + F.log1p(F.lit(-1.0) / a) - (F.log(F.lit(delta)) + F.log(a)) / (a - 1)
    least = F.array_min(F.transform(F.sequence(F.lit(2), F.lit(255)), lambda a: each(a.cast("double"))))
    return F.when((sigma <= 0) | (q <= 0), F.lit(float("inf"))).otherwise(F.greatest(least, F.lit(0.0)))


def lots(n: Column, epochs: Column, size: int = 8) -> Column:
    """Steps of a training run: full lots of n texts, one at least, by epochs."""
    return F.greatest(F.lit(1), F.floor(n / size)) * epochs


def weighted(values: Column, weights: Column) -> Column:
    """Weighted mean of an array; null without weights."""
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), F.lit(0.0))
