"""Rounding of prices as vendors publish them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round2(x: Column) -> Column:
    """Two decimal digits of the exact expansion of a double, ties to even; null and NaN stay, zero has no sign.

    The product with 100 is taken with its rounding error (the factor is split so that both partial products are exact),
    so the distance from a tie is known exactly. From 2**46 on doubles are coarser than a hundredth and stay.
    """
    a = F.abs(x)
    big = a * 134217729.0
    high = big - (big - a)
    product = a * 100.0
    error = (high * 100.0 - product) + (a - high) * 100.0
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(whole % 2)
    # the error may reach over the whole number itself
    down = F.when((product == whole) & (error < -0.5), -1.0).otherwise(0.0)
    rounded = (whole + up + down) / 100.0
    return F.when(x.isNull() | F.isnan(x) | (a >= 2.0**46), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded) + 0.0)


def vendor_change(close: Column, before: Column) -> tuple[Column, Column, Column, Column]:
    """Rounded close and previous close, and change and percent from these, rounded too; percent is 0 where there is no previous price."""
    c, b = exact_round2(close), exact_round2(before)
    change = c - b
    return c, b, exact_round2(change), F.when(F.abs(b) < 2.0**-52, 0.0).otherwise(exact_round2(change / b * 100.0))
