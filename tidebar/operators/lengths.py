"""Windows of many lengths over one frame and one sort.

A mean of any length is the difference of two prefix sums (of decimals, so that long
series lose nothing), and a maximum of any length is the larger of two maxima over the
same power of two: two look-ups for each length, whatever the length.  What depends on a
length through a state (the last breakout, a streak) is one running window for each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_ticker, rows

#: Holds sums of prices below 10^16 with ten decimals.
EXACT = "decimal(28,10)"


def _back(name: str, n: int) -> Column:
    return F.col(name) if n == 0 else F.lag(name, n).over(by_ticker())


def _maximum(n: int, first: int) -> Column:
    """The highest high of the n bars that end `first` bars before this one; null unless all have a high."""
    k = n.bit_length() - 1
    known = _back("__high_n", first) - F.coalesce(_back("__high_n", n + first), F.lit(0)) == n
    return F.when(known, F.greatest(_back(f"__max_{k}", first), _back(f"__max_{k}", n + first - (1 << k))))


def _mean(n: int, first: int) -> Column:
    known = _back("__close_n", first) - F.coalesce(_back("__close_n", n + first), F.lit(0)) == n
    total = _back("__close_sum", first) - F.coalesce(_back("__close_sum", n + first), F.lit(0).cast(EXACT))
    return F.when(known, total.cast("double") / n)


def with_lengths(df: DataFrame, prior: Iterable[int] = (), high: Iterable[int] = (), mean: Iterable[tuple[int, int]] = ()) -> DataFrame:
    """Adds prior_{n}, the highest high of the n bars before; high_{n}, with this bar; mean_{n}_{k}, the mean close of n bars k bars ago."""
    prior, high, mean = sorted(set(prior)), sorted(set(high)), sorted(set(mean))
    so_far = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    base: dict[str, Column] = {}
    if prior or high:
        base["__high_n"] = F.count("high").over(so_far)
        base |= {f"__max_{k}": F.max("high").over(rows(1 << k)) for k in sorted({n.bit_length() - 1 for n in (*prior, *high)})}
    if mean:
        base |= {"__close_n": F.count("close").over(so_far), "__close_sum": F.sum(F.col("close").cast(EXACT)).over(so_far)}
    if not base:
        return df
    found = {f"prior_{n}": _maximum(n, 1) for n in prior} | {f"high_{n}": _maximum(n, 0) for n in high} | {f"mean_{n}_{k}": _mean(n, k) for n, k in mean}
    return df.withColumns(base).withColumns(found).drop(*base)


def with_last_breakouts(df: DataFrame, prior: Iterable[int]) -> DataFrame:
    """Adds since_{n}: (level, days) of the last bar that closed above prior_{n}."""
    out = {}
    for n in sorted(set(prior)):
        above = F.when(F.col("close") > F.col(f"prior_{n}"), F.struct(F.col(f"prior_{n}").alias("level"), F.col("rn").alias("rn")))
        last = F.last(above, ignorenulls=True).over(by_ticker())
        out[f"since_{n}"] = F.when(last.isNotNull(), F.struct(last["level"].alias("level"), (F.col("rn") - last["rn"]).cast("int").alias("days")))
    return df.withColumns(out) if out else df


def with_streaks(df: DataFrame, levels: Iterable[float]) -> DataFrame:
    """Adds streak_{i} for the i-th level: the bars in a row with an rsi below it, up to this one."""
    out = {}
    for i, level in enumerate(levels):
        below = F.coalesce(F.col("rsi") < float(level), F.lit(False))
        above = F.coalesce(F.last(F.when(~below, F.col("rn")), ignorenulls=True).over(by_ticker()), F.lit(0))
        out[f"streak_{i}"] = F.when(below, F.col("rn") - above).otherwise(0).cast("int")
    return df.withColumns(out) if out else df


def with_returns(df: DataFrame, market: DataFrame, ks: Iterable[int]) -> DataFrame:
    """Adds strength_{k}: the k-bar return less the market's on the same date; the market is one row for each day of one calendar."""
    ks = sorted(set(ks))
    w = Window.orderBy("bar_date")
    once = F.when(F.lag("bar_date").over(w) == F.col("bar_date"), F.raise_error(F.lit("repeated day in the market table")).cast("double"))
    days = market.select("bar_date", *(once.otherwise(F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1).alias(f"__m_{k}") for k in ks))
    own = {f"__r_{k}": F.try_divide(F.col("close"), F.lag("close", k).over(by_ticker())) - 1 for k in ks}
    out = df.withColumns(own).join(F.broadcast(days), "bar_date", "left")
    return out.withColumns({f"strength_{k}": F.col(f"__r_{k}") - F.col(f"__m_{k}") for k in ks}).drop(*own, *(f"__m_{k}" for k in ks))
