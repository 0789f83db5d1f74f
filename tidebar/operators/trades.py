"""Entry fills, bracket exits and trade generation as table operations.

A signal looks at the bars after it through one forward frame of bounded length
(entry wait plus holding time), on the same partitioning and order as the
indicators, so resolving trades adds no exchange.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..functions.numeric import round_even
from .indicators import by_ticker, with_indicators
from .joins import bars_after, catalyst_warning, market_uptrend, next_earnings
from .levels import breakout_filters, by_strategy, dispatch, levels
from .scoring import scored

AHEAD = ["open", "high", "low", "close", "bar_date"]


def with_ahead(frame: DataFrame, bars: int) -> DataFrame:
    """Adds `ahead`, the next `bars` bars in order."""
    return frame.withColumn("ahead", F.collect_list(F.struct(*AHEAD)).over(by_ticker().rowsBetween(1, bars)))


def _numbered(ahead: Column) -> Column:
    return F.transform(ahead, lambda x, i: F.struct((i + 1).alias("k"), x.alias("bar")))


def limit_fill(ahead: Column, price: Column, wait: int) -> Column:
    """(k, price) of the first of `wait` bars that opens at or below a limit, or trades down to it; else null."""
    hit = F.get(F.filter(F.slice(_numbered(ahead), 1, wait), lambda x: (x["bar"]["open"] <= price) | (x["bar"]["low"] <= price)), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["k"].alias("k"), F.when(hit["bar"]["open"] <= price, hit["bar"]["open"]).otherwise(price).alias("price"), hit["bar"]["bar_date"].alias("bar_date")))


def stop_fill(ahead: Column, price: Column, wait: int) -> Column:
    """(k, price) of the first of `wait` bars that opens at or above a trigger, or trades up to it; else null."""
    hit = F.get(F.filter(F.slice(_numbered(ahead), 1, wait), lambda x: (x["bar"]["open"] >= price) | (x["bar"]["high"] >= price)), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["k"].alias("k"), F.when(hit["bar"]["open"] >= price, hit["bar"]["open"]).otherwise(price).alias("price"), hit["bar"]["bar_date"].alias("bar_date")))


def exit_verdict(bar, day: Column, stop: Column, target: Column, max_holding: Column, slippage: Column) -> Column:
    """The first rule that a bar meets, in order; null where it meets none."""
    made = lambda status, price, reason: F.struct(F.lit(status).alias("status"), price.alias("price"), F.lit(reason).alias("reason"), day.cast("int").alias("days"), bar["bar_date"].alias("date"))
    return (
        F.when(bar["open"] <= stop, made("LOSS", bar["open"], "gap_down_stop"))
        .when(bar["open"] >= target, made("WIN", bar["open"], "gap_up_target"))
        .when(bar["low"] <= stop, made("LOSS", stop * (1 - slippage), "stop_hit_intraday"))
        .when(bar["high"] >= target, made("WIN", target, "target_hit"))
        .when(day >= max_holding, made("EXPIRED", bar["close"], "expired"))
    )


def resolve(rows: DataFrame, ahead: str, buy: str, stop: str, target: str, max_holding, slippage, commission) -> DataFrame:
    """Adds status, exit_price, exit_reason, holding_days, pnl_pct, exit_date from the bars in `ahead`; OPEN where none decides."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    verdicts = F.transform(F.col(ahead), lambda b, i: exit_verdict(b, i + 1, F.col(stop), F.col(target), lit(max_holding), lit(slippage)))
    df = rows.withColumn("__x", F.get(F.filter(verdicts, lambda v: v.isNotNull()), F.lit(0)))
    pnl = (F.col("__x.price") - F.col(buy)) / F.col(buy) * 100 - lit(commission)
    return df.select(
        *rows.columns, F.coalesce("__x.status", F.lit("OPEN")).alias("status"), round_even(F.col("__x.price"), 2).alias("exit_price"), F.col("__x.reason").alias("exit_reason"),
        F.col("__x.days").alias("holding_days"), round_even(pnl, 2).alias("pnl_pct"), F.col("__x.date").alias("exit_date"),
    )


def tradable_frame(bars: DataFrame, market: DataFrame, cfg: StrategyConfig, earnings: DataFrame | None = None, strength: bool | None = None) -> DataFrame:
    """Indicators of the days of a rising market, with the bars ahead and the next report; relative strength where breakouts need it."""
    strength = cfg.strategy == "breakout" if strength is None else strength
    frame = with_ahead(with_indicators(bars, cfg, market if strength else None), cfg.max_entry_wait + cfg.max_holding)
    if earnings is not None:
        frame = next_earnings(frame, earnings)
    else:
        frame = frame.withColumn("next_earnings_ts", F.lit(None).cast("timestamp"))
    return market_uptrend(frame, market, cfg.sma_trend).where("market_up")


def candidates_in(frame: DataFrame, cfg: StrategyConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scored levels rows that pass all gates, with the bars ahead: one row for each tradable bar."""
    rows = levels(frame, cfg, keep=("ahead", "next_earnings_ts", *keep))
    rows = rows.withColumn("catalyst_warning", catalyst_warning(cfg.earnings_warning_days, "as_of"))
    return scored(rows, cfg)


def candidates(bars: DataFrame, market: DataFrame, cfg: StrategyConfig, earnings: DataFrame | None = None) -> DataFrame:
    return candidates_in(tradable_frame(bars, market, cfg, earnings), cfg)


def fires(cfg: StrategyConfig) -> Column:
    """Which candidates are signals: the label for rsi, the trigger (and filters) for the others."""
    if cfg.strategy == "rsi":
        return F.col("signal").isin("Strong Buy", "Buy")
    return F.col("trigger") & breakout_filters(cfg) if cfg.strategy == "breakout" else F.col("trigger")


def filled(rows: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """Candidate rows with their fill `__f`, null where there is none."""
    fill = stop_fill if cfg.strategy == "breakout" else limit_fill
    return rows.withColumn("__f", fill(F.col("ahead"), F.col("buy_price"), cfg.max_entry_wait))


def settled(rows: DataFrame, cfg: StrategyConfig, keep: tuple = ()) -> DataFrame:
    """Trades of filled rows: entry, bracket from the real entry price with the rounded ATR, exit."""
    df = rows.where("__f IS NOT NULL")
    price = F.col("__f.price")
    df = df.withColumns({"__entry": price, "__stop": round_even(price - F.col("atr") * cfg.sl_mult, 2), "__target": round_even(price + F.col("atr") * cfg.tp_mult, 2), "__after": F.slice(F.col("ahead"), F.col("__f.k") + 1, F.lit(cfg.max_holding))})
    df = resolve(df, "__after", "__entry", "__stop", "__target", cfg.max_holding, cfg.slippage, cfg.commission)
    extra = ["trade_score", "rsi", "rrr"] if cfg.strategy == "rsi" else []
    return df.select(
        "ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"), "strategy", F.col("as_of").alias("signal_date"), F.col("__f.bar_date").alias("entry_date"), "signal", "atr",
        F.col("__entry").alias("buy_price"), F.col("buy_price").alias("signal_buy_price"), F.col("__stop").alias("stop_loss"), F.col("__target").alias("sell_price"), "catalyst_warning", *extra,
        "status", "exit_price", "exit_reason", "holding_days", "pnl_pct", "exit_date", *keep,
    )


def fill_and_settle(rows: DataFrame, cfg: StrategyConfig, keep: tuple = ()) -> DataFrame:
    return settled(filled(rows, cfg), cfg, keep)


def make_trades(bars: DataFrame, market: DataFrame, cfg: StrategyConfig, earnings: DataFrame | None = None) -> DataFrame:
    return fill_and_settle(candidates(bars, market, cfg, earnings).where(fires(cfg)), cfg)


#: Parameters that shape the frame of indicators and the bars ahead.
FRAME = (
    "ma_window", "support_lookback", "rsi_window", "atr_window", "rsi_oversold", "decline_days", "sma_trend", "volume_lookback", "breakout_lookback", "adx_window", "obv_window",
    "bb_window", "squeeze_window", "pullback_ma", "pullback_slope", "week52_lookback", "max_entry_wait", "max_holding", "earnings_warning_days",
)


def universe_trades(bars: DataFrame, market: DataFrame, configs: list[StrategyConfig], earnings: DataFrame | None = None) -> DataFrame:
    """Trades of several strategies over one bars table; those with the same windows share one frame, each strategy once.

    trade_score, rsi and rrr are those of rsi trades, null for others.  An unknown strategy is an error.
    """
    groups: list[list[StrategyConfig]] = []
    for c in configs:
        fits = lambda g, c=c: all(getattr(c, p) == getattr(g[0], p) for p in FRAME) and c.strategy not in {x.strategy for x in g}
        home = next((g for g in groups if fits(g)), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    out = None
    for group in groups:
        frame = tradable_frame(bars, market, group[0], earnings, any(c.strategy == "breakout" for c in group))
        rows = dispatch(frame, group, keep=("ahead", "next_earnings_ts")).withColumn("catalyst_warning", catalyst_warning(group[0].earnings_warning_days, "as_of"))
        fire = F.lit(False)
        for c in group:
            fire = fire | ((F.col("strategy") == c.strategy) & fires(c))
        rows = scored(rows, *group).where(fire)
        price, wait = F.col("buy_price"), group[0].max_entry_wait
        rows = rows.withColumn("__f", F.when(F.col("strategy") == "breakout", stop_fill(F.col("ahead"), price, wait)).otherwise(limit_fill(F.col("ahead"), price, wait)))
        own = {p: by_strategy({c.strategy: getattr(c, p) for c in group}) for p in ("tp_mult", "sl_mult", "slippage", "commission")}
        only = [F.when(F.col("strategy") == "rsi", F.col(x)).alias(x) for x in ("trade_score", "rsi", "rrr")]
        part = settled(rows, replace(group[0], strategy="several", **own), tuple(only))
        out = part if out is None else out.unionByName(part)
    return out


def random_baseline(bars: DataFrame, market: DataFrame, cfg: StrategyConfig, seed: str, earnings: DataFrame | None = None) -> DataFrame:
    """As many random gated days of each ticker as it has filled trades, filled and settled alike; unfilled picks are dropped.

    Counts and ranks are windows by ticker over one frame of candidates.
    """
    rows = filled(candidates(bars, market, cfg, earnings), cfg)
    real = F.count_if(fires(cfg) & F.col("__f").isNotNull()).over(Window.partitionBy("ticker"))
    order = Window.partitionBy("ticker").orderBy(F.md5(F.concat_ws("|", "ticker", F.col("as_of").cast("string"), F.lit(seed))))
    return settled(rows.withColumns({"__n": real, "__k": F.row_number().over(order)}).where("__k <= __n"), cfg)


def settle_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Stored signals against their later bars: no entry wait, each with its own snapshot of max_holding, slippage, commission.

    A signal meets the `max_holding` bars after it only; the first deciding bar is a grouped minimum.
    """
    entry = F.coalesce(F.nullif("fill_price", F.lit(0.0)), F.col("buy_price"))
    own = signals.select("ticker", "signal_date", "strategy", entry.alias("entry_price"), "stop_loss", "sell_price", *(F.col("config")[c].alias(c) for c in ("max_holding", "slippage", "commission")))
    later = bars_after(own, bars.select("ticker", *AHEAD), F.col("max_holding"))
    verdict = F.when(F.col("bar").isNotNull(), exit_verdict(F.col("bar"), F.col("k"), F.col("stop_loss"), F.col("sell_price"), F.col("max_holding"), F.col("slippage")))
    first = F.min_by("v", F.when(F.col("v").isNotNull(), F.col("k")))
    keys = ["ticker", "signal_date", "strategy"]
    out = later.withColumn("v", verdict).groupBy(*keys, "entry_price", "commission").agg(first.alias("v"))
    pnl = (F.col("v.price") - F.col("entry_price")) / F.col("entry_price") * 100 - F.col("commission")
    return out.select(*keys, "entry_price", F.coalesce("v.status", F.lit("OPEN")).alias("status"), round_even(F.col("v.price"), 2).alias("exit_price"), F.col("v.reason").alias("exit_reason"), F.col("v.days").alias("holding_days"), round_even(pnl, 2).alias("pnl_pct"), F.col("v.date").alias("exit_date"))


def resettle(signals: DataFrame, changed: DataFrame, bars: DataFrame) -> DataFrame:
    """Settled signals whose confirmation has changed, settled again."""
    return settle_signals(signals.where("settled").join(changed, ["ticker", "signal_date", "strategy"], "left_semi"), bars)


def folds(days: DataFrame, start: str, end: str, in_days: int = 182, out_days: int = 30, step_days: int = 30, day: str = "bar_date") -> DataFrame:
    """(fold_id, is_start, is_end, oos_start, oos_end): rolling windows over the days of a bars table between start and end.

    The first window starts at the first day from `start` on, the last one ends by the last day before `end`.
    """
    span = days.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date"))).agg(F.min(day).alias("a"), F.date_add(F.max(day), 1).alias("z")).where("a IS NOT NULL")
    df = span.select("z", F.posexplode(F.sequence("a", "z", F.expr(f"interval {step_days} days"))).alias("fold_id", "is_start")).withColumn("is_end", F.date_add("is_start", in_days))
    df = df.select("fold_id", "is_start", "is_end", F.col("is_end").alias("oos_start"), F.date_add("is_end", out_days).alias("oos_end"), "z")
    return df.where("oos_end <= z").drop("z")
