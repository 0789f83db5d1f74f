"""Column helpers with the rounding and null rules of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding by scaling; null stays null."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Null-preserving clamp: least and greatest alone would skip nulls."""
    y = x
    of = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    if low is not None:
        y = F.greatest(y, of(low))
    if high is not None:
        y = F.least(y, of(high))
    return F.when(x.isNotNull(), y)


def reward_risk(buy: Column, sell: Column, stop: Column) -> Column:
    risk = buy - stop
    return F.when(risk > 0, round_even((sell - buy) / risk, 2)).otherwise(F.lit(0.0))
