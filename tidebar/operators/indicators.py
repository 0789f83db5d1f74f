"""Rolling and Wilder-smoothed indicators: windows over (ticker, bar_date) only.

All windows share one partitioning and one order, so a frame of indicators needs one
exchange.  Columns that a query does not use are pruned with their windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig


def by_ticker():
    """A ticker's bars in order (made on use: a window needs a session)."""
    return Window.partitionBy("ticker").orderBy("bar_date")


def rows(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def full(agg: Column, x: Column | str, n: int, frame=None) -> Column:
    """The aggregate over n rows, null until n values exist."""
    x = F.col(x) if isinstance(x, str) else x
    frame = rows(n) if frame is None else frame
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def sma(x: str, n: int) -> Column:
    return full(F.avg(x), x, n)


def prior_high(n: int) -> Column:
    """Highest high of the n bars before this one."""
    return full(F.max("high"), "high", n, by_ticker().rowsBetween(-n, -1))


def support(n: int) -> tuple[Column, Column]:
    """Lowest low of at most n bars, and the first date that has it."""
    low = F.when(F.col("low").isNotNull(), F.struct("low", "bar_date"))
    best = F.min(low).over(rows(n))
    return best["low"], best["bar_date"]


def wilder_all(df: DataFrame, outs: dict[str, str], n: int, least: int | None = None) -> DataFrame:
    """Adds for each column x of `outs` its y_t = y_{t-1} + (x_t - y_{t-1}) / n, from the first row on where all are known, null before n (or `least`) values.

    Closed form with prefix sums, y_t = r^t (x_0 + a sum x_i r^-i) with r = 1 - 1/n, in
    blocks so that r^-i stays small: a block is so long that r^block is below double
    precision, and takes over the last value of the block before it.  Columns of one
    call share the count, the blocks and their sort; a row where one of them is null
    is skipped by all.
    """
    if n == 1:
        return df.withColumns({y: F.col(x) for x, y in outs.items()})
    a, r = 1.0 / n, 1.0 - 1.0 / n
    block = max(64, math.ceil(37.0 / -math.log(r)))
    known = F.lit(True)
    for x in outs:
        known = known & F.col(x).isNotNull()
    tag = next(iter(outs.values()))
    t, b = f"__t_{tag}", f"__b_{tag}"
    df = df.withColumn(t, F.when(known, F.count_if(known).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) - 1)).withColumn(b, F.floor(F.col(t) / block))
    m = F.pmod(t, F.lit(block))
    inside = Window.partitionBy("ticker", b).orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    # The first value weighs 1, all others a.
    term = lambda x: F.when(F.col(t) == 0, F.col(x)).otherwise(F.col(x) * a) * F.pow(F.lit(r), -m)
    df = df.withColumns({f"__s_{y}": F.sum(term(x)).over(inside) * F.pow(F.lit(r), m) for x, y in outs.items()})
    # What the block before ends in: the last row whose place in its block is the last one.  Same sort as `inside`.
    earlier = Window.partitionBy("ticker").orderBy(b, "bar_date").rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda y: F.last(F.when(m == block - 1, F.col(f"__s_{y}")), ignorenulls=True).over(earlier)
    value = lambda y: F.col(f"__s_{y}") + F.when(F.col(b) > 0, F.coalesce(ends(y), F.lit(0.0)) * F.pow(F.lit(r), m + 1)).otherwise(0.0)
    df = df.withColumns({y: F.when(F.col(t) >= (n if least is None else least) - 1, value(y)) for y in outs.values()})
    return df.drop(t, b, *(f"__s_{y}" for y in outs.values()))


def wilder(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return wilder_all(df, {x: out}, n)


def one_before(x: str) -> Column:
    return F.lag(x).over(by_ticker())


def moves(before=one_before) -> dict[str, Column]:
    """Rises and falls of the close; `before` gives a column of the bar before."""
    change = F.col("close") - before("close")
    return {"__up": F.greatest(change, F.lit(0.0) * change), "__down": F.greatest(-change, F.lit(0.0) * change)}


def strength() -> Column:
    return F.try_divide(F.lit(100.0) * F.col("__gain"), F.col("__gain") + F.col("__loss"))


def rsi(df: DataFrame, n: int, out: str = "rsi") -> DataFrame:
    df = wilder_all(df.withColumns(moves()), {"__up": "__gain", "__down": "__loss"}, n)
    return df.withColumn(out, strength()).drop("__up", "__down", "__gain", "__loss")


def true_range(before=one_before) -> Column:
    """Null on the first bar: greatest skips nulls, so it is guarded."""
    close = before("close")
    return F.when(close.isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close)))


def atr(df: DataFrame, n: int, out: str = "atr") -> DataFrame:
    return wilder(df.withColumn("__tr", true_range()), "__tr", n, out).drop("__tr")


def ranges(before=one_before) -> dict[str, Column]:
    """True range and directional moves."""
    up, down = F.col("high") - before("high"), before("low") - F.col("low")
    known = up.isNotNull() & down.isNotNull()
    return {"__tr": true_range(before), "__plus": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)), "__minus": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0))}


def directional(tr: str) -> Column:
    pdi, mdi = F.try_divide(F.col("__pdm"), F.col(tr)), F.try_divide(F.col("__mdm"), F.col(tr))
    return F.lit(100.0) * F.try_divide(F.abs(pdi - mdi), pdi + mdi)


def adx(df: DataFrame, n: int, out: str = "adx", atr_out: str = "__atr") -> DataFrame:
    """Adds the average directional index, and the average true range of the same length where `atr_out` names it."""
    df = wilder_all(df.withColumns(ranges()), {"__tr": atr_out, "__plus": "__pdm", "__minus": "__mdm"}, n)
    df = df.withColumn("__dx", directional(atr_out))
    return wilder(df, "__dx", n, out).drop("__tr", "__plus", "__minus", "__atr", "__pdm", "__mdm", "__dx")


def streak(df: DataFrame, below: Column, out: str = "oversold_streak_days") -> DataFrame:
    """Adds the number of bars in a row up to this one that are below; null counts as not below.

    The first bar of a ticker never starts a streak of more than the bars that exist.
    """
    flag = F.coalesce(below, F.lit(False))
    df = df.withColumn("__rn", F.row_number().over(by_ticker())).withColumn("__flag", flag)
    last_above = F.coalesce(F.last(F.when(~F.col("__flag"), F.col("__rn")), ignorenulls=True).over(by_ticker()), F.lit(0))
    return df.withColumn(out, F.when(F.col("__flag"), F.col("__rn") - last_above).otherwise(0).cast("int")).drop("__rn", "__flag")


def z_score(x: str, n: int) -> Column:
    return F.try_divide(F.col(x) - full(F.avg(x), x, n), full(F.stddev_samp(x), x, n))


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_ticker())) * F.col("volume"), F.lit(0.0))
    return df.withColumn("__step", step).withColumn(out, F.sum("__step").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def with_indicators(bars: DataFrame, cfg: StrategyConfig, market: DataFrame | None = None) -> DataFrame:
    """Bars with all indicator columns of the five strategies; `market` bars add relative strength.

    Columns are added level by level, each level from those before it, so that windows
    of one level are one operator and the plan stays short.  The smoothed ones, which sort
    by blocks, come first, while rows are narrow.
    """
    w = by_ticker()
    df = rsi(bars, cfg.rsi_window)
    if cfg.atr_window == cfg.adx_window:
        df = adx(df, cfg.adx_window, atr_out="atr")
    else:
        df = adx(atr(df, cfg.atr_window), cfg.adx_window)
    level, day = support(cfg.support_lookback)
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume"), F.lit(0.0))
    df = df.withColumns({
        "rn": F.row_number().over(w), "sma": sma("close", cfg.ma_window), "sma_trend": sma("close", cfg.sma_trend), "avg_volume": sma("volume", cfg.volume_lookback),
        "highest_high": prior_high(cfg.breakout_lookback), "week52_high": full(F.max("high"), "high", cfg.week52_lookback), "support_level": level, "support_date": day, "__step": step,
        "volatility": F.try_divide(full(F.stddev_samp("close"), "close", cfg.bb_window), full(F.avg("close"), "close", cfg.bb_window)),
        "k_return": F.try_divide(F.col("close"), F.lag("close", cfg.breakout_lookback).over(w)) - 1, "ma_pullback": sma("close", cfg.pullback_ma),
    })
    df = df.withColumns({
        "avg_volume_prior": F.lag("avg_volume").over(w), "obv": F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__sq": z_score("volatility", cfg.squeeze_window),
        "ma_pullback_prior": F.lag("ma_pullback", cfg.pullback_slope).over(w), "breakout_flag": F.coalesce(F.col("close") > F.col("highest_high"), F.lit(False)),
    })
    since = lambda c: F.last(F.when(F.col("breakout_flag"), F.col(c)), ignorenulls=True).over(w)
    df = df.withColumns({
        "obv_zscore": z_score("obv", cfg.obv_window), "squeeze_zscore": F.lag("__sq").over(w), "last_breakout_level": since("highest_high"),
        "days_since_breakout": (F.col("rn") - since("rn")).cast("int"), "volume_ratio": F.try_divide(F.col("volume"), F.col("avg_volume_prior")),
    })
    df = streak(df.drop("__step", "__sq"), F.col("rsi") < cfg.rsi_oversold).withColumn("extended_decline_warning", F.col("oversold_streak_days") >= cfg.decline_days)
    if market is None:
        return df.withColumn("relative_strength", F.lit(None).cast("double"))
    return relative_strength(df, market, cfg.breakout_lookback)


def market_returns(market: DataFrame, k: int) -> DataFrame:
    """(bar_date, market_return): a row for each trading day of one index, so small."""
    w = Window.orderBy("bar_date")
    once = F.when(F.lag("bar_date").over(w) == F.col("bar_date"), F.raise_error(F.lit("repeated day in the market table")).cast("double"))
    return market.select("bar_date", once.otherwise(F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1).alias("market_return"))


def relative_strength(df: DataFrame, market: DataFrame, k: int) -> DataFrame:
    """The k-bar return less the market's on the same date; null where the market has no bar."""
    joined = df.join(F.broadcast(market_returns(market, k)), "bar_date", "left")  # days of one calendar
    return joined.withColumn("relative_strength", F.col("k_return") - F.col("market_return")).drop("market_return")


def latest(df: DataFrame) -> DataFrame:
    """Each ticker's last row."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("bar_date")))).where("__n = 1").drop("__n")
