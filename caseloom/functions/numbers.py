"""Columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**27 + 1: splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits by its exact binary value, halves to even: 0.60835 lies below its decimal and gives 0.6083.

    ``F.round`` rounds the shortest decimal that stands for x, which differs at halves. For magnitudes below about 1e9.
    """
    scale = float(10**digits)
    high = lambda v: v * _SPLIT - (v * _SPLIT - v)
    p = x * scale
    xh, sh = high(x), float(scale * _SPLIT - (scale * _SPLIT - scale))
    xl, sl = x - xh, scale - sh
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p)
    over = (p - low) - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    return (low + F.when(up, 1).otherwise(0)).cast("double") / scale
