"""Normal and chi-square distributions. Spark has no erf; tails are computed on the few rows of a result."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation (Abramowitz and Stegun 26.2.23).
_C = (2.515517, 0.802853, 0.010328)
_D = (1.432788, 0.189269, 0.001308)


def norm_ppf(p: float) -> float:
    """Inverse of the normal distribution, -6 and 6 at the ends."""
    if p <= 0 or p >= 1:
        return -6.0 if p <= 0 else 6.0
    if p == 0.5:
        return 0.0
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = t - (_C[0] + t * (_C[1] + t * _C[2])) / (1 + t * (_D[0] + t * (_D[1] + t * _D[2])))
    return -x if p < 0.5 else x


def norm_ppf_column(p: Column) -> Column:
    """``norm_ppf`` as column arithmetic."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    x = t - (_C[0] + t * (_C[1] + t * _C[2])) / (1 + t * (_D[0] + t * (_D[1] + t * _D[2])))
    return F.when(p <= 0, -6.0).when(p >= 1, 6.0).when(p == 0.5, 0.0).when(p < 0.5, -x).otherwise(x)


def norm_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def chi2_sf(x: float | None, df: int | None) -> float | None:
    """Upper tail of the chi-square distribution: the regularised upper gamma function at df/2, x/2."""
    if x is None or df is None:
        return None
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    if y < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= y / n
            total += term
        return 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a))
    b, c = y + 1 - a, 1e300  # continued fraction of the upper one
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(-y + a * math.log(y) - math.lgamma(a)) * h


def chi2_p_value(x: Column, df: Column) -> Column:
    return F.udf(chi2_sf, "double", useArrow=True)(x, df)
