"""Gates and entry levels of the five strategies, one row for each bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..functions.numeric import reward_risk, round_even

CORE = ["ticker", "sector", "as_of", "strategy", "last_close", "rsi", "atr", "buy_price", "sell_price", "stop_loss", "rrr", "distance_to_buy_pct", "trigger", "exclude_reason"]
OWN = {
    "rsi": ["sma", "ma_discount_price", "support_level", "support_date", "oversold_streak_days", "extended_decline_warning"],
    "breakout": ["trigger_price", "relative_strength", "volume_ratio", "adx", "obv_zscore", "squeeze_zscore"],
    "pullback": ["ma_pullback", "adx"],
    "retest": ["days_since_breakout", "adx"],
    "week52": ["week52_high"],
}


def exclude_reason(cfg: StrategyConfig) -> Column:
    """The first gate that a bar fails, in the fixed order; null where it passes all."""
    need = {
        "rsi": [("close", "no close"), ("sma", "short history: sma"), ("sma_trend", "short history: trend"), ("rsi", "short history: rsi"), ("atr", "short history: atr"), ("avg_volume", "short history: volume")],
        "breakout": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("highest_high", "short history: high")],
        "pullback": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("ma_pullback", "short history: pullback"), ("ma_pullback_prior", "short history: slope")],
        "retest": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume")],
        "week52": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("week52_high", "short history: high")],
    }[cfg.strategy]
    tests = [F.when(F.col(c).isNull(), reason) for c, reason in need]
    tests.append(F.when(F.col("close") < F.col("sma_trend"), "downtrend"))
    tests.append(F.when(F.col("avg_volume") * F.col("close") < cfg.min_dollar_volume, "illiquid"))
    return F.coalesce(*tests)


def entry(cfg: StrategyConfig, at: Callable[[str], Column] = F.col) -> tuple[Column, Column, Column]:
    """Buy price, unrounded distance in percent, trigger flag; `at` gives the columns."""
    close = at("close")
    if cfg.strategy == "rsi":
        buy = round_even(at("support_level"), 2)
        return buy, (close - buy) / buy * 100, (close <= buy) & (at("rsi") < cfg.rsi_oversold)
    if cfg.strategy == "breakout":
        buy = round_even(at("highest_high"), 2)
        return buy, (close - buy) / buy * 100, close > at("highest_high")
    if cfg.strategy == "pullback":
        buy = round_even(at("ma_pullback"), 2)
        far = (close - buy) / buy * 100
        return buy, far, (at("ma_pullback") > at("ma_pullback_prior")) & (F.abs(far) <= cfg.pullback_band)
    if cfg.strategy == "retest":
        known = at("last_breakout_level").isNotNull() & at("days_since_breakout").isNotNull()
        buy = F.when(known, round_even(at("last_breakout_level"), 2)).otherwise(round_even(close, 2))
        far = F.when(known, (close - buy) / buy * 100).otherwise(0.0)
        days = at("days_since_breakout")
        return buy, far, known & (days > 0) & (days <= cfg.retest_window) & (F.abs(far) <= cfg.retest_band)
    if cfg.strategy == "week52":
        far = (at("week52_high") - close) / at("week52_high") * 100
        return round_even(close, 2), far, far <= cfg.week52_nearness
    raise ValueError(f"unknown strategy {cfg.strategy!r}")


def by_strategy(values: dict[str, Column | float]) -> Column:
    """The strategy's own value: a constant where all agree."""
    first = next(iter(values.values()))
    if len(values) == 1 or all(isinstance(v, (int, float)) and v == first for v in values.values()):
        return first if isinstance(first, Column) else F.lit(first)
    out = F.lit(None).cast("double")
    for s, v in values.items():
        out = F.when(F.col("strategy") == s, v).otherwise(out)
    return out


def dispatch(frame: DataFrame, configs: list[StrategyConfig], keep: tuple[str, ...] = ()) -> DataFrame:
    """Levels of each bar for each of the strategies, with all their own columns (null for other strategies).

    One frame of indicators, so the configurations share their window lengths; a bar
    becomes one row for each strategy.  Gates and brackets use unrounded indicators, the
    bracket hangs on the rounded buy price, and the shown columns are rounded.
    """
    entries = []
    for c in configs:
        buy, far, trigger = entry(c)
        entries.append(F.struct(F.lit(c.strategy).alias("strategy"), exclude_reason(c).alias("exclude_reason"), buy.alias("buy"), far.alias("far"), F.coalesce(trigger, F.lit(False)).alias("trigger")))
    df = frame.withColumn("__e", F.explode(F.array(*entries)) if len(entries) > 1 else entries[0]).withColumn("strategy", F.col("__e.strategy"))
    tp, sl = (by_strategy({c.strategy: getattr(c, p) for c in configs}) for p in ("tp_mult", "sl_mult"))
    buy = F.col("__e.buy")
    df = df.withColumns({"__sell": round_even(buy + F.col("atr") * tp, 2), "__stop": round_even(buy - F.col("atr") * sl, 2)})
    discount = by_strategy({c.strategy: c.ma_discount for c in configs})
    shown = {
        "sma": round_even(F.col("sma"), 2), "ma_discount_price": round_even(F.col("sma") * (1 - discount), 2), "support_level": round_even(F.col("support_level"), 2),
        "trigger_price": buy, "relative_strength": round_even(F.col("relative_strength"), 4), "volume_ratio": round_even(F.col("volume_ratio"), 3), "adx": round_even(F.col("adx"), 2),
        "obv_zscore": round_even(F.col("obv_zscore"), 3), "squeeze_zscore": round_even(F.col("squeeze_zscore"), 3), "ma_pullback": buy, "week52_high": round_even(F.col("week52_high"), 2),
    }
    names = list(dict.fromkeys(x for c in configs for x in OWN[c.strategy]))
    having = lambda x: [c.strategy for c in configs if x in OWN[c.strategy]]
    own = [(shown.get(x, F.col(x)) if len(having(x)) == len(configs) else F.when(F.col("strategy").isin(having(x)), shown.get(x, F.col(x)))).alias(x) for x in names]
    sector = F.col("sector") if "sector" in frame.columns else F.lit(None).cast("string")
    return df.select(
        "ticker", sector.alias("sector"), F.col("bar_date").alias("as_of"), "strategy",
        round_even(F.col("close"), 2).alias("last_close"), round_even(F.col("rsi"), 2).alias("rsi"), round_even(F.col("atr"), 2).alias("atr"),
        buy.alias("buy_price"), F.col("__sell").alias("sell_price"), F.col("__stop").alias("stop_loss"), reward_risk(buy, F.col("__sell"), F.col("__stop")).alias("rrr"),
        round_even(F.col("__e.far"), 2).alias("distance_to_buy_pct"), F.col("__e.trigger").alias("trigger"), F.col("__e.exclude_reason").alias("exclude_reason"),
        *own, *keep,
    )


def levels(frame: DataFrame, cfg: StrategyConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Levels of each bar of an indicator frame for one strategy."""
    return dispatch(frame, [cfg], keep)


def skip_list(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(ticker, reason): failed gates, and tickers of the universe without any bar."""
    out = rows.where("exclude_reason IS NOT NULL").select("ticker", F.col("exclude_reason").alias("reason"))
    if universe is not None:
        missing = universe.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")
        out = out.unionByName(missing.select("ticker", F.lit("no bars").alias("reason")))
    return out


def breakout_filters(cfg: StrategyConfig) -> Column:
    """The six sharpening filters on the rounded columns; null passes each."""
    tests = [
        F.col("rsi").isNull() | (F.col("rsi") < cfg.breakout_rsi_max),
        F.col("relative_strength").isNull() | (F.col("relative_strength") >= cfg.breakout_relative_strength_min),
        F.col("volume_ratio").isNull() | (F.col("volume_ratio") >= cfg.breakout_volume_ratio_min),
        F.col("adx").isNull() | (F.col("adx") >= cfg.breakout_adx_min),
        F.col("obv_zscore").isNull() | (F.col("obv_zscore") >= cfg.breakout_obv_min),
        F.col("squeeze_zscore").isNull() | (F.col("squeeze_zscore") <= cfg.breakout_squeeze_max),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def review_holdings(holdings: DataFrame, frame: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """Each holding against stop and target anchored at its average cost, on its ticker's last bar."""
    from .indicators import latest

    last = latest(frame).where("atr IS NOT NULL").select("ticker", "bar_date", "close", F.col("atr").alias("__atr"))
    df = holdings.where("avg_cost IS NOT NULL").join(last, "ticker")
    df = df.withColumn("stop_loss", round_even(F.col("avg_cost") - F.col("__atr") * cfg.sl_mult, 2)).withColumn("sell_price", round_even(F.col("avg_cost") + F.col("__atr") * cfg.tp_mult, 2))
    return df.select(
        "ticker", F.col("bar_date").alias("as_of"), round_even(F.col("avg_cost"), 2).alias("avg_cost"), round_even(F.col("close"), 2).alias("last_close"), round_even(F.col("__atr"), 2).alias("atr"),
        "stop_loss", "sell_price", round_even((F.col("close") - F.col("avg_cost")) / F.col("avg_cost") * 100, 2).alias("unrealized_pnl_pct"),
        F.when(F.col("close") <= F.col("stop_loss"), "SELL (stop breached)").when(F.col("close") >= F.col("sell_price"), "SELL (target hit)").otherwise("HOLD").alias("recommendation"),
    )
