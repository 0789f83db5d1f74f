"""Scores from 0 to 100 and signal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..functions.numeric import clip, round_even
from .levels import breakout_filters


def signal_label(score: Column, cfg: StrategyConfig) -> Column:
    return F.when(score > cfg.strong_buy_above, "Strong Buy").when(score >= cfg.buy_from, "Buy").when(score >= cfg.watch_from, "Watch").otherwise("Ignore")


def _parts(cfg: StrategyConfig) -> tuple[Column, Column]:
    reward = clip(F.col("rrr"), 0, cfg.rrr_cap) / cfg.rrr_cap * cfg.rrr_weight
    near = (1 - clip(F.col("distance_to_buy_pct"), 0, cfg.distance_cap) / cfg.distance_cap) * cfg.distance_weight
    return reward, near


def streak_penalty(cfg: StrategyConfig) -> Column:
    return clip(clip(F.col("oversold_streak_days") - cfg.decline_days, 0) * cfg.decline_penalty, None, cfg.decline_penalty_cap)


def trade_score(cfg: StrategyConfig) -> Column:
    reward, near = _parts(cfg)
    if cfg.strategy == "rsi":
        low = (cfg.rsi_ceiling - clip(F.col("rsi"), cfg.rsi_floor, cfg.rsi_ceiling)) / (cfg.rsi_ceiling - cfg.rsi_floor) * cfg.rsi_weight
        return round_even(clip(reward + low + near - streak_penalty(cfg), 0), 1)
    total = cfg.rrr_weight + cfg.distance_weight
    raw = clip((reward + near) * (100 / total if total > 0 else 0.0), 0)
    eligible = F.col("trigger") & breakout_filters(cfg) if cfg.strategy == "breakout" else F.col("trigger")
    return round_even(F.when(eligible, raw).otherwise(0.0), 1)


def scored(rows: DataFrame, *configs: StrategyConfig) -> DataFrame:
    """Levels rows that pass the gates, with trade_score and signal, each by the configuration of its strategy."""
    score, label = trade_score(configs[0]), signal_label(F.col("trade_score"), configs[0])
    for c in configs[1:]:
        mine = F.col("strategy") == c.strategy
        score, label = F.when(mine, trade_score(c)).otherwise(score), F.when(mine, signal_label(F.col("trade_score"), c)).otherwise(label)
    # The score is a deep expression.  Marked as not deterministic it is computed once, and
    # filters on scores and labels do not copy it into themselves over and over.
    once = F.when(F.monotonically_increasing_id() >= 0, score)
    return rows.where("exclude_reason IS NULL").withColumn("trade_score", once).withColumn("signal", label)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("trade_score"), "ticker")


def actionable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("signal").isin("Strong Buy", "Buy"))


def loosened_only(active: DataFrame, loosened: DataFrame) -> DataFrame:
    """Rows of the loosened configuration that can be logged and that the active one scored Ignore."""
    ignored = active.where("signal = 'Ignore'").select("ticker", "as_of")
    return loosened.where(F.col("signal").isin("Strong Buy", "Buy", "Watch")).join(ignored, ["ticker", "as_of"], "left_semi")
