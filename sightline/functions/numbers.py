"""Rounding and clamping as the scores define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at the given digits: halves go up, also below zero."""
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score100(x: Column) -> Column:
    """Rounded and clamped to 0..100, an int."""
    return clamp(half_up(x), 0, 100).cast("int")
