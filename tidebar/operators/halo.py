"""Indicators of long series, split in time: no task holds more than a span of a ticker and its look-back.

A ticker's bars are numbered without putting them together (numbers inside calendar years,
and what the years before hold), and cut into spans of so many bars.  Each span is sent with the
bars before it that its windows look back on (its halo); smoothed values forget what
lies before the halo, to the last bit.  States without an end (on-balance volume, streaks,
the last breakout) are carried from span to span by one row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..sources.bars import YEAR
from . import short
from .indicators import relative_strength, with_indicators


def look_back(cfg: StrategyConfig) -> int:
    """Bars before a bar that its indicators depend on: of the smoothed ones, until less than one part in 2^53 is left.

    Smoothed twice, as the directional index is, a value of k bars ago weighs (1 + k / n) r^k; a thousandth of
    that is asked for, as the index divides by sums that may be smaller now than they were.
    """

    def smooth(n: int, twice: bool = False) -> int:
        k, fade = 1, -math.log(1.0 - 1.0 / n) if n > 1 else math.inf
        while k * fade < (44.0 + math.log1p(k / n) if twice else 37.0):
            k += 1
        return k + n

    plain = (cfg.ma_window, cfg.sma_trend, cfg.volume_lookback + 1, cfg.breakout_lookback + 1, cfg.week52_lookback, cfg.support_lookback, cfg.pullback_ma + cfg.pullback_slope, cfg.bb_window + cfg.squeeze_window + 1, cfg.obv_window + 1)
    return 2 + max(*plain, smooth(cfg.rsi_window), smooth(cfg.atr_window), smooth(cfg.adx_window, twice=True))


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with rn, their number in their ticker (from 1), kn, the number of bars with all prices up to them, and k_all, that number for the whole ticker.

    Bars that come with `bar_year`, partitioned by it and their ticker, are not sent anywhere for that.
    """
    known = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    df = bars if YEAR in bars.columns else bars.withColumn(YEAR, F.year("bar_date"))
    # The join by ticker and year drops bars without one; said here, both sides read the same and share one shuffle.
    df = df.where(F.col("ticker").isNotNull() & F.col(YEAR).isNotNull())
    per_year = df.groupBy("ticker", YEAR).agg(F.count("*").alias("__n"), F.count_if(known).alias("__k")).withColumnsRenamed({"ticker": "__t", YEAR: "__y"})
    before = Window.partitionBy("__t").orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_year.select("__t", "__y", F.sum("__k").over(Window.partitionBy("__t")).alias("k_all"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__k0"))
    inside = Window.partitionBy("ticker", YEAR).orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"rn": F.count("*").over(inside), "kn": F.count_if(known).over(inside)})
    df = df.join(starts, (F.col("ticker") == F.col("__t")) & (F.col(YEAR) == F.col("__y")))
    return df.withColumns({"rn": F.col("rn") + F.col("__n0"), "kn": F.col("kn") + F.col("__k0")}).drop(YEAR, "__t", "__y", "__n0", "__k0")


def in_spans(bars: DataFrame, span: int, back: int) -> DataFrame:
    """Numbered bars with __home, the span a bar is of, and __span, the span it is sent to; each span has bars of its own."""
    df = numbered(bars).withColumn("__home", F.greatest(F.floor((F.col("kn") - 1) / span), F.lit(0)))
    # The last `back` bars with prices of a span, and what lies among them, go to the next span as well, if there is one.
    more = ((F.col("__home") + 1) * span < F.col("k_all")) & (F.col("kn") > (F.col("__home") + 1) * span - back)
    return df.withColumn("__span", F.explode(F.when(more, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))


def with_indicators_by_span(bars: DataFrame, cfg: StrategyConfig, market: DataFrame | None = None, span: int = 4096, whole_bars: bool = False) -> DataFrame:
    """The columns of `with_indicators`, computed span by span; a span is at least as long as the look-back.

    `whole_bars` says that a bar with a close has a high and a low, so that a span and its look-back have no more
    closes than bars with prices.  Nothing is written: the spans are shuffled once and read twice, for
    what each ends in and for the rows, which stay where they are when that is joined.
    """
    back = look_back(cfg)
    span = max(span, back)
    df = in_spans(bars, span, back)
    columns = [c for c in bars.columns if c not in (YEAR, "ticker")]
    df = df.select(*columns, F.col("ticker").alias("__ticker"), F.col("rn").alias("__number"), "__home", "__span", F.concat_ws("\u0001", "ticker", F.col("__span").cast("string")).alias("ticker"))
    df = short.with_indicators(df, cfg).withColumn("relative_strength", F.lit(None).cast("double")) if whole_bars and short.fits(cfg, span + back) else with_indicators(df, cfg)
    w = Window.partitionBy("ticker").orderBy("bar_date")
    # What the halo has added to the volume when the span begins, and the span's own last bar so far that is not oversold.
    above = F.last(F.when((F.col("__home") == F.col("__span")) & (F.col("oversold_streak_days") == 0), F.col("__number")), ignorenulls=True).over(w)
    df = df.withColumns({"__halo_obv": F.coalesce(F.last(F.when(F.col("__home") < F.col("__span"), F.col("obv")), ignorenulls=True).over(w), F.lit(0.0)), "__own_above": above})
    df = df.where("__home = __span").withColumn("obv", F.col("obv") - F.col("__halo_obv")).drop("__halo_obv")
    # The last row is taken with all columns of its bar, so that both readings of the spans need the same ones and share one shuffle.
    ends = df.groupBy("ticker", "__ticker", "__span").agg(
        F.max_by(F.struct("obv", *columns), "__number")["obv"].alias("__obv"), F.max(F.when(F.col("oversold_streak_days") == 0, F.col("__number"))).alias("__above"),
        F.max(F.when(F.col("breakout_flag"), F.struct(F.col("__number").alias("rn"), F.col("highest_high").alias("level")))).alias("__out"),
    )
    before = Window.partitionBy("__ticker").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("ticker").alias("__key"), F.coalesce(F.sum("__obv").over(before), F.lit(0.0)).alias("__obv0"), F.max("__above").over(before).alias("__above0"), F.max("__out").over(before).alias("__out0"))
    df = df.join(carried, F.col("ticker") == F.col("__key"))
    streak = F.when(F.col("oversold_streak_days") == 0, 0).otherwise(F.col("__number") - F.coalesce("__own_above", "__above0", F.lit(0))).cast("int")
    df = df.withColumns({
        "obv": F.col("obv") + F.col("__obv0"), "__streak": streak, "days_since_breakout": F.coalesce("days_since_breakout", (F.col("__number") - F.col("__out0.rn")).cast("int")),
        "last_breakout_level": F.coalesce("last_breakout_level", F.col("__out0.level")),
    })
    df = df.withColumns({"oversold_streak_days": F.col("__streak"), "extended_decline_warning": F.col("__streak") >= cfg.decline_days, "rn": F.col("__number"), "ticker": F.col("__ticker")})
    df = df.drop("__home", "__span", "__ticker", "__number", "__key", "__obv0", "__above0", "__out0", "__own_above", "__streak")
    return df if market is None else relative_strength(df.drop("relative_strength"), market, cfg.breakout_lookback)
