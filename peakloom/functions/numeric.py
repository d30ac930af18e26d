"""Numeric column functions that SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published Chebyshev fit of erfc.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def d(value: float) -> Column:
    """A double literal; a bare 0.1 would be a decimal in SQL."""
    return F.lit(float(value)).cast("double")


def erfc(z: Column) -> Column:
    """erfc for z >= 0, with a relative error of about 1e-7."""
    t = 1 / (1 + z / 2)
    poly = d(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = d(c) + t * poly
    return t * F.exp(-z * z + poly)


def chi2_p(chi2: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return F.least(d(1), erfc(F.sqrt(F.greatest(chi2, d(0)) / 2)))  # the fit is a little over 1 at 0


def ratio(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """a / b with a denominator of at least ``floor``."""
    return a / F.greatest(b.cast("double"), d(floor))


def finite(value: Column) -> Column:
    """As a double; null for text that is no number, NaN and infinities."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def relative(value: Column, most: Column) -> Column:
    return F.when(most > 0, value / most).otherwise(d(0))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), d(0), lambda s, x: s + x)


def cosine_warmup(step: Column, rate: float, warm: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up to ``rate``, then a cosine down to ``floor`` times it."""
    low = rate * floor
    p = F.least(d(1), (step - warm).cast("double") / max(1, total - warm))
    return F.when(step < warm, d(rate) * (step + 1) / max(1, warm)).otherwise(d(low) + d(0.5 * (rate - low)) * (1 + F.cos(F.pi() * p)))
