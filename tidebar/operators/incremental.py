"""Indicators of new bars from a state for each ticker, so that a day costs a day and not its history.

The state holds the last bars that windows look back on, the smoothed values with their
counts, and the running volume, streak and breakout.  A batch of new bars is joined with
the state once; a ticker's new bars (those of the batch) are then taken in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig
from .indicators import by_ticker, rows, true_range, wilder_all

PRICES = ["open", "high", "low", "close", "volume"]
SMOOTHED = ["gain", "loss", "tr", "plus", "minus", "dx"]
BAR = "struct<bar_date:date,open:double,high:double,low:double,close:double,volume:double>"
#: The state of a ticker; `ring` has its last bars, `averages` those of the pullback mean.
STATE_FIELDS = ["bar_date date", f"ring array<{BAR}>", "averages array<double>", *(f"{x} double" for x in SMOOTHED), "n_change long", "n_range long", "n_dx long", "obv double", "streak int", "level double", "days int", "rn long"]
STATE = ", ".join(["ticker string", *STATE_FIELDS])
ROW = ["rn", "sma", "sma_trend", "avg_volume_prior", "volume_ratio", "highest_high", "week52_high", "support_level", "rsi", "atr", "adx", "obv", "oversold_streak_days", "ma_pullback", "ma_pullback_prior", "last_breakout_level", "days_since_breakout"]


def ring_size(cfg: StrategyConfig) -> int:
    return 1 + max(cfg.ma_window, cfg.sma_trend, cfg.volume_lookback + 1, cfg.breakout_lookback + 1, cfg.week52_lookback, cfg.support_lookback, cfg.pullback_ma)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _last(values: Column, n: int, skip: int = 0) -> Column:
    """The n values before the last `skip`; null where there are fewer or one is null."""
    part = F.slice(values, F.size(values) - skip - n + 1, F.lit(n))
    return F.when((F.size(values) >= n + skip) & F.forall(part, lambda x: x.isNotNull()), part)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def state_after(bars: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """The state of each ticker after all its bars, computed in one batch."""
    w = by_ticker()
    change = F.col("close") - F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    both = up.isNotNull() & down.isNotNull()
    df = bars.withColumns({
        "__up": F.greatest(change, F.lit(0.0) * change), "__down": F.greatest(-change, F.lit(0.0) * change), "__tr": true_range(), "rn": F.row_number().over(w).cast("long"),
        "__plus": F.when(both, F.when((up > down) & (up > 0), up).otherwise(0.0)), "__minus": F.when(both, F.when((down > up) & (down > 0), down).otherwise(0.0)), "__step": F.coalesce(F.signum(change) * F.col("volume"), F.lit(0.0)),
    })
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = wilder_all(wilder_all(df, {"__up": "gain", "__down": "loss"}, cfg.rsi_window, 1), {"__tr": "tr", "__plus": "plus", "__minus": "minus"}, cfg.adx_window, 1)
    df = df.withColumns({"n_change": F.count("__up").over(so_far), "n_range": F.count("tr").over(so_far)})
    plus, minus = F.try_divide("plus", "tr"), F.try_divide("minus", "tr")
    df = wilder_all(df.withColumn("__dx", F.when(F.col("n_range") >= cfg.adx_window, F.lit(100.0) * F.try_divide(F.abs(plus - minus), plus + minus))), {"__dx": "dx"}, cfg.adx_window, 1)
    full = F.when(F.count("close").over(rows(cfg.pullback_ma)) == cfg.pullback_ma, F.avg("close").over(rows(cfg.pullback_ma)))
    high = F.when(F.count("high").over(w.rowsBetween(-cfg.breakout_lookback, -1)) == cfg.breakout_lookback, F.max("high").over(w.rowsBetween(-cfg.breakout_lookback, -1)))
    rsi = F.when(F.col("n_change") >= cfg.rsi_window, F.try_divide(F.lit(100.0) * F.col("gain"), F.col("gain") + F.col("loss")))
    df = df.withColumns({**{x: F.last(x, ignorenulls=True).over(so_far) for x in SMOOTHED}, "n_dx": F.count("__dx").over(so_far), "obv": F.sum("__step").over(so_far), "__ma": full, "__hh": high, "__below": F.coalesce(rsi < cfg.rsi_oversold, F.lit(False))})
    out = F.last(F.when(F.col("close") > F.col("__hh"), F.struct("rn", F.col("__hh").alias("level"))), ignorenulls=True).over(w)
    above = F.coalesce(F.last(F.when(~F.col("__below"), F.col("rn")), ignorenulls=True).over(w), F.lit(0))
    last = lambda x, n: F.collect_list(x).over(rows(n))
    df = df.withColumns({"level": out["level"], "days": (F.col("rn") - out["rn"]).cast("int"), "streak": (F.col("rn") - above).cast("int"), "ring": last(F.struct("bar_date", *PRICES), ring_size(cfg)), "averages": last(F.struct(F.col("__ma").alias("x")), cfg.pullback_slope + 1)["x"]})
    names = [f.split(" ")[0] for f in STATE_FIELDS]
    return df.groupBy("ticker").agg(F.max_by(F.struct(*names), "bar_date").alias("s")).select("ticker", "s.*")


def _step(s: Column, x: Column, cfg: StrategyConfig) -> Column:
    """The state after one more bar, with its indicator row in `out`."""
    before = F.element_at(s["ring"], -1)
    has = F.size(s["ring"]) > 0
    old = lambda c: F.when(has, before[c])
    change = x["close"] - old("close")
    up, down = x["high"] - old("high"), old("low") - x["low"]
    both = up.isNotNull() & down.isNotNull()
    range_ = F.when(old("close").isNotNull() & x["high"].isNotNull() & x["low"].isNotNull(), F.greatest(x["high"] - x["low"], F.abs(x["high"] - old("close")), F.abs(x["low"] - old("close"))))
    moved = F.struct(
        F.greatest(change, F.lit(0.0) * change).alias("gain"), F.greatest(-change, F.lit(0.0) * change).alias("loss"), range_.alias("tr"),
        F.when(both, F.when((up > down) & (up > 0), up).otherwise(0.0)).alias("plus"), F.when(both, F.when((down > up) & (down > 0), down).otherwise(0.0)).alias("minus"),
    )
    smooth = lambda y, v, n: F.when(v.isNull(), y).otherwise(F.coalesce(y + (v - y) / n, v))
    size = ring_size(cfg)

    def smoothed(m: Column) -> Column:
        triple = m["tr"].isNotNull() & m["plus"].isNotNull()
        only = lambda c: F.when(triple, m[c])
        ring = F.slice(F.concat(s["ring"], F.array(x)), F.greatest(F.size(s["ring"]) + 2 - size, F.lit(1)), F.lit(size))
        return F.struct(
            smooth(s["gain"], m["gain"], cfg.rsi_window).alias("gain"), smooth(s["loss"], m["loss"], cfg.rsi_window).alias("loss"), *(smooth(s[c], only(c), cfg.adx_window).alias(c) for c in ("tr", "plus", "minus")),
            (s["n_change"] + F.when(m["gain"].isNotNull(), 1).otherwise(0)).alias("n_change"), (s["n_range"] + F.when(triple, 1).otherwise(0)).alias("n_range"), m["gain"].isNotNull().alias("changed"), triple.alias("ranged"),
            ring.alias("ring"), F.transform(ring, lambda b: b["close"]).alias("closes"), F.transform(ring, lambda b: b["high"]).alias("highs"), F.transform(ring, lambda b: b["volume"]).alias("volumes"),
            (s["obv"] + F.coalesce(F.signum(change) * x["volume"], F.lit(0.0))).alias("obv"),
        )

    def measured(t: Column) -> Column:
        shown = t["ranged"] & (t["n_range"] >= cfg.adx_window)
        plus, minus = F.try_divide(t["plus"], t["tr"]), F.try_divide(t["minus"], t["tr"])
        dx = F.when(shown, F.lit(100.0) * F.try_divide(F.abs(plus - minus), plus + minus))
        rsi = F.when(t["changed"] & (t["n_change"] >= cfg.rsi_window), F.try_divide(F.lit(100.0) * t["gain"], t["gain"] + t["loss"]))
        low = F.array_min(F.transform(F.slice(t["ring"], F.greatest(F.size(t["ring"]) - cfg.support_lookback + 1, F.lit(1)), F.lit(cfg.support_lookback)), lambda b: b["low"]))
        average = lambda v, n, skip=0: let(_last(v, n, skip), lambda p: F.when(p.isNotNull(), _mean(p)))
        return F.struct(
            t.alias("t"), rsi.alias("rsi"), F.when(shown, t["tr"]).alias("atr"), dx.alias("dx"), low.alias("support_level"), average(t["closes"], cfg.ma_window).alias("sma"), average(t["closes"], cfg.sma_trend).alias("sma_trend"),
            average(t["volumes"], cfg.volume_lookback, 1).alias("avg_volume_prior"), F.array_max(_last(t["highs"], cfg.breakout_lookback, 1)).alias("highest_high"), F.array_max(_last(t["highs"], cfg.week52_lookback)).alias("week52_high"), average(t["closes"], cfg.pullback_ma).alias("ma"),
        )

    def put(r: Column) -> Column:
        t = r["t"]
        n_dx = s["n_dx"] + F.when(r["dx"].isNotNull(), 1).otherwise(0)
        adx = smooth(s["dx"], r["dx"], cfg.adx_window)
        streak = F.when(F.coalesce(r["rsi"] < cfg.rsi_oversold, F.lit(False)), s["streak"] + 1).otherwise(0)
        broke = F.coalesce(x["close"] > r["highest_high"], F.lit(False))
        level, days = F.when(broke, r["highest_high"]).otherwise(s["level"]), F.when(broke, 0).otherwise(s["days"] + 1)
        averages = F.slice(F.concat(s["averages"], F.array(r["ma"])), F.greatest(F.size(s["averages"]) + 1 - cfg.pullback_slope, F.lit(1)), F.lit(cfg.pullback_slope + 1))
        prior = F.when(F.size(averages) > cfg.pullback_slope, F.element_at(averages, 1))
        row = F.struct(
            x["bar_date"].alias("bar_date"), (s["rn"] + 1).alias("rn"), *(r[c].alias(c) for c in ("sma", "sma_trend", "avg_volume_prior")), F.try_divide(x["volume"], r["avg_volume_prior"]).alias("volume_ratio"), *(r[c].alias(c) for c in ("highest_high", "week52_high", "support_level", "rsi", "atr")),
            F.when(r["dx"].isNotNull() & (n_dx >= cfg.adx_window), adx).alias("adx"), t["obv"].alias("obv"), streak.alias("oversold_streak_days"), r["ma"].alias("ma_pullback"), prior.alias("ma_pullback_prior"), level.alias("last_breakout_level"), days.alias("days_since_breakout"),
        )
        return F.struct(
            x["bar_date"].alias("bar_date"), t["ring"].alias("ring"), averages.alias("averages"), *(t[c].alias(c) for c in SMOOTHED[:-1]), adx.alias("dx"), t["n_change"].alias("n_change"), t["n_range"].alias("n_range"), n_dx.alias("n_dx"),
            t["obv"].alias("obv"), streak.cast("int").alias("streak"), level.alias("level"), days.cast("int").alias("days"), (s["rn"] + 1).alias("rn"), F.concat(s["out"], F.array(row)).alias("out"),
        )

    return let(moved, lambda m: let(smoothed(m), lambda t: let(measured(t), put)))


def advance(state: DataFrame, bars: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """The state after the new bars, with the indicator rows of them in `out`; tickers without new bars keep theirs.

    Bars up to a ticker's last date are ignored, so a batch that comes again changes nothing.
    Ranges and directions are smoothed over one length (atr_window equals adx_window).
    """
    if cfg.atr_window != cfg.adx_window:
        raise ValueError("the state smooths ranges over one length: atr_window must equal adx_window")
    new = bars.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("bar_date", *(F.col(c).cast("double").alias(c) for c in PRICES)))).alias("new"))
    row = "struct<bar_date:date,rn:bigint,sma:double,sma_trend:double,avg_volume_prior:double,volume_ratio:double,highest_high:double,week52_high:double,support_level:double,rsi:double,atr:double,adx:double,obv:double,oversold_streak_days:int,ma_pullback:double,ma_pullback_prior:double,last_breakout_level:double,days_since_breakout:int>"
    zero = {"ring": F.array().cast(f"array<{BAR}>"), "averages": F.array().cast("array<double>"), "n_change": F.lit(0).cast("long"), "n_range": F.lit(0).cast("long"), "n_dx": F.lit(0).cast("long"), "obv": F.lit(0.0), "streak": F.lit(0), "rn": F.lit(0).cast("long")}
    fields = [f.strip() for f in STATE_FIELDS]
    names = [f.split(" ")[0] for f in fields]
    kind = f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields)}, out:array<{row}>>"
    start = F.struct(*(F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c).alias(c) for c in names), F.array().cast(f"array<{row}>").alias("out")).cast(kind)
    both = state.select("ticker", *names).join(new, "ticker", "full")
    later = F.filter(F.coalesce("new", F.array().cast(f"array<{BAR}>")), lambda x: F.col("bar_date").isNull() | (x["bar_date"] > F.col("bar_date")))
    return both.select("ticker", F.aggregate(later, start, lambda s, x: _step(s, x, cfg).cast(kind)).alias("s")).select("ticker", "s.*")


def rows_of(advanced: DataFrame) -> DataFrame:
    """(ticker, bar_date, indicators) of the bars that an `advance` took."""
    return advanced.select("ticker", F.explode("out").alias("r")).select("ticker", "r.*")
