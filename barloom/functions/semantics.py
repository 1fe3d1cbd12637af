"""Row-wise arithmetic, comparison and logic of the formula language.

Numbers are nullable doubles and booleans are never null. Comparisons have a tolerance of EPS and are false where a side
is null or NaN (``ne`` is true for NaN); a quotient by (nearly) zero is 0; AND and OR are false where a side is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def num(x) -> Column:
    """A number from a column, a Python number or a boolean column."""
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def flag(x) -> Column:
    """A boolean from a number: non-zero is true, null is false."""
    return F.coalesce(num(x) != 0, F.lit(False))


def _known(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def gt(a, b) -> Column:
    a, b = num(a), num(b)
    return F.coalesce(_known(a, b) & (a > b + EPS), F.lit(False))


def lt(a, b) -> Column:
    return gt(b, a)


def ge(a, b) -> Column:
    a, b = num(a), num(b)
    return F.coalesce(_known(a, b) & ((a > b) | (F.abs(a - b) <= EPS)), F.lit(False))


def le(a, b) -> Column:
    return ge(b, a)


def eq(a, b) -> Column:
    a, b = num(a), num(b)
    return F.coalesce(_known(a, b) & (F.abs(a - b) <= EPS), F.lit(False))


def ne(a, b) -> Column:
    a, b = num(a), num(b)
    return F.coalesce(F.when(_known(a, b), F.abs(a - b) > EPS).otherwise(a.isNotNull() & b.isNotNull()), F.lit(False))


def within(x, low, high, closed_low: bool = True, closed_high: bool = True) -> Column:
    """x IN [low, high], with either end open on request."""
    return (ge if closed_low else gt)(x, low) & (le if closed_high else lt)(x, high)


def both(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), False).otherwise((a != 0) & (b != 0))


def either(a, b) -> Column:
    """OR; null OR true is false."""
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), False).otherwise((a != 0) | (b != 0))


def negate(a) -> Column:
    return ~flag(a)


def div(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.abs(b) < EPS, 0.0).otherwise(F.try_divide(a, b))


def ieee_div(a, b) -> Column:
    """a / b where zero has reciprocals: infinity by the sign of a, NaN for 0 / 0; null if a side is null."""
    a, b = num(a), num(b)
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(a.isNotNull() & (b == 0), F.when(F.isnan(a), a).otherwise(by_zero)).otherwise(F.try_divide(a, b))


def ieee_log(x) -> Column:
    """Natural logarithm: minus infinity at 0 and NaN below, where Spark's is null; null stays."""
    x = num(x)
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


def larger(a, b) -> Column:
    """MAX: null if a side is null; NaN gives way to a number."""
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def smaller(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def choose(c, a, b) -> Column:
    return F.when(flag(c), num(a)).otherwise(num(b))


def round_half_away(x: Column, digits: int) -> Column:
    """Half away from zero on the multiplied double."""
    f = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f
