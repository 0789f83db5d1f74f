"""Samples, holdouts, sweeps and picks of configurations."""

from __future__ import annotations

from dataclasses import fields, replace
from itertools import product
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..sources.shared import kept
from .indicators import with_indicators
from .joins import market_uptrend
from .lengths import with_last_breakouts, with_lengths, with_returns, with_streaks
from .levels import entry
from .metrics import cluster_weights, max_drawdown, penalised, summary, weighted_summary
from .trades import candidates_in, fill_and_settle, fires, with_ahead

#: What a sweep may vary, by strategy, with bounds.
TAKE_PROFIT, STOP_LOSS = (1.0, 3.0), (0.25, 5.0)
SEARCH_SPACE = {
    "rsi": {"rsi_oversold": (15.0, 70.0), "tp_mult": TAKE_PROFIT, "sl_mult": STOP_LOSS, "decline_penalty": (0.0, 4.0), "decline_penalty_cap": (0.0, 50.0)},
    "breakout": {"breakout_lookback": (10, 80), "tp_mult": TAKE_PROFIT, "sl_mult": STOP_LOSS, "breakout_rsi_max": (50.0, 100.0), "breakout_relative_strength_min": (-50.0, 15.0), "breakout_volume_ratio_min": (0.0, 3.0), "breakout_adx_min": (0.0, 40.0), "breakout_obv_min": (-3.0, 3.0), "breakout_squeeze_max": (-3.0, 3.0)},
    "pullback": {"pullback_ma": (10, 50), "pullback_slope": (3, 30), "pullback_band": (0.5, 10.0), "tp_mult": TAKE_PROFIT, "sl_mult": STOP_LOSS},
    "retest": {"breakout_lookback": (10, 80), "retest_window": (3, 30), "retest_band": (0.5, 10.0), "tp_mult": TAKE_PROFIT, "sl_mult": STOP_LOSS},
    "week52": {"week52_lookback": (100, 252), "week52_nearness": (0.5, 15.0), "tp_mult": TAKE_PROFIT, "sl_mult": STOP_LOSS},
}
#: Parameters that only matter after the levels, so that a grid of them shares one frame of indicators.
LATE = ("tp_mult", "sl_mult", "max_holding", "max_entry_wait", "slippage", "commission")
#: Parameters that a sweep takes as columns, whatever their values: with LATE, all bounds of the search and the thresholds.
VARIED = tuple(dict.fromkeys([*LATE, *(p for space in SEARCH_SPACE.values() for p in space)]))


def by_hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def sample_tickers(universe: DataFrame, k: int, seed: str) -> DataFrame:
    """k tickers in the order of a seeded hash; tickers with a dot are left out."""
    return universe.where(~F.col("ticker").contains(".")).select("ticker").distinct().orderBy(by_hash("ticker", F.lit(seed)), "ticker").limit(k)


def stratified_holdout(universe: DataFrame, share: float, seed: str) -> DataFrame:
    """(ticker, sector, holdout): round-half-even(share * tickers) of each sector by a seeded hash."""
    w = Window.partitionBy("sector")
    rank = F.row_number().over(w.orderBy(by_hash("ticker", F.lit(seed)), "ticker"))
    n = F.rint(F.count("*").over(w) * F.lit(float(max(share, 0.0))))
    return universe.select("ticker", "sector").distinct().select("ticker", "sector", (rank <= n).alias("holdout"))


def cohort_table(real: DataFrame, random: DataFrame, holdout: DataFrame) -> DataFrame:
    """Weighted summaries of real and random trades over all, tuning and holdout tickers."""
    both = real.select("ticker", "sector", "entry_date", "status", "pnl_pct", F.lit("real").alias("cohort")).unionByName(random.select("ticker", "sector", "entry_date", "status", "pnl_pct", F.lit("random").alias("cohort")))
    both = both.where("status <> 'OPEN'").join(holdout.select("ticker", "holdout"), "ticker", "left")
    both = both.withColumn("split", F.explode(F.array(F.lit("all"), F.when(F.coalesce("holdout", F.lit(False)), "holdout").otherwise("tune"))))
    return weighted_summary(cluster_weights(both, ["cohort", "split"]), ["cohort", "split"])


def grid(base: StrategyConfig, **values: list) -> dict[int, StrategyConfig]:
    """All combinations, numbered from 0."""
    return {i: replace(base, **dict(zip(values, v, strict=True))) for i, v in enumerate(product(*values.values()))}


def search_grid(base: StrategyConfig, points: int, names: tuple[str, ...] | None = None) -> dict[int, StrategyConfig]:
    """Configurations at `points` even places of each of the strategy's bounds, the others kept: a star about `base`, which is number 0."""
    out = [base]
    for name, (low, high) in SEARCH_SPACE[base.strategy].items():
        if names and name not in names:
            continue
        whole = isinstance(low, int) and isinstance(getattr(base, name), int)
        for k in range(points):
            value = low + (high - low) * k / max(1, points - 1)
            out.append(replace(base, **{name: round(value) if whole else float(value)}))
    return dict(enumerate(dict.fromkeys(out)))


def halton(n: int, dims: int, seed: int) -> list[list[float]]:
    """n points of [0, 1)^dims that fill it evenly: a Halton sequence whose digits are permuted by a seed, 0 kept."""
    primes: list[int] = []
    k = 2
    while len(primes) < dims:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    out = [[0.0] * dims for _ in range(n)]
    for d, p in enumerate(primes):
        turned = [0, *Random(f"{seed}:{p}").sample(range(1, p), p - 1)]
        for i in range(n):
            x, scale, rest = 0.0, 1.0 / p, i + 1
            while rest:
                x, scale, rest = x + turned[rest % p] * scale, scale / p, rest // p
            out[i][d] = x
    return out


def search_points(base: StrategyConfig, n: int, seed: int) -> dict[int, StrategyConfig]:
    """n configurations that fill all bounds of the strategy's search space evenly, numbered from 1; number 0 is `base`."""
    space = SEARCH_SPACE[base.strategy]
    out = {0: base}
    for i, point in enumerate(halton(n, len(space), seed), 1):
        values = {}
        for (name, (low, high)), u in zip(space.items(), point, strict=True):
            whole = isinstance(getattr(base, name), int)
            values[name] = int(low + u * (high - low + 1)) if whole else round(low + u * (high - low), 6)
        out[i] = replace(base, **values)
    return out


def _own_values(cfg: StrategyConfig, configs: list[StrategyConfig], streaks: list[float]) -> dict[str, Column]:
    """Columns of the frame that depend on swept lengths, as one configuration has them; those that all share are the frame's own."""
    several = lambda *names: len({tuple(getattr(c, n) for n in names) for c in configs}) > 1
    n, out = cfg.breakout_lookback, {}
    if cfg.strategy == "breakout" and several("breakout_lookback"):
        out |= {"highest_high": F.col(f"prior_{n}"), "relative_strength": F.col(f"strength_{n}")}
    if cfg.strategy == "retest" and several("breakout_lookback"):
        out |= {"last_breakout_level": F.col(f"since_{n}")["level"], "days_since_breakout": F.col(f"since_{n}")["days"]}
    if cfg.strategy == "pullback" and several("pullback_ma", "pullback_slope"):
        out |= {"ma_pullback": F.col(f"mean_{cfg.pullback_ma}_0"), "ma_pullback_prior": F.col(f"mean_{cfg.pullback_ma}_{cfg.pullback_slope}")}
    if cfg.strategy == "week52" and several("week52_lookback"):
        out["week52_high"] = F.col(f"high_{cfg.week52_lookback}")
    if cfg.strategy == "rsi" and several("rsi_oversold"):
        out["oversold_streak_days"] = F.col(f"streak_{streaks.index(cfg.rsi_oversold)}")
        out["extended_decline_warning"] = out["oversold_streak_days"] >= cfg.decline_days
    return out


def sweep(bars: DataFrame, market: DataFrame, configs: dict[int, StrategyConfig]) -> DataFrame:
    """Trades of all configurations with config_id.

    Configurations of one strategy that differ in VARIED parameters only are one frame of
    indicators over one sort, which looks as far ahead as the farthest of them.  Swept
    lengths are look-ups in that frame (`lengths`); a bar meets a configuration only where
    its trigger holds.  Other window lengths make a branch of their own.
    """
    wait, hold = max(c.max_entry_wait for c in configs.values()), max(c.max_holding for c in configs.values())
    groups: dict[tuple, list[int]] = {}
    for i, cfg in configs.items():
        groups.setdefault(tuple(getattr(cfg, f.name) for f in fields(cfg) if f.name not in VARIED), []).append(i)
    out = None
    for members in groups.values():
        some = [configs[i] for i in members]
        early = replace(some[0], max_entry_wait=wait, max_holding=hold)
        streaks = sorted({c.rsi_oversold for c in some})
        own = {i: _own_values(configs[i], some, streaks) for i in members}
        swept = bool(own[members[0]])
        frame = with_indicators(bars, early, market if early.strategy == "breakout" and not swept else None)
        if swept:
            lookbacks = {c.breakout_lookback for c in some} if early.strategy in ("breakout", "retest") else set()
            frame = with_lengths(frame, lookbacks, {c.week52_lookback for c in some} if early.strategy == "week52" else (), {(c.pullback_ma, k) for c in some for k in (0, c.pullback_slope)} if early.strategy == "pullback" else ())
            if early.strategy == "breakout":
                frame = with_returns(frame, market, lookbacks)
            frame = with_last_breakouts(frame, lookbacks if early.strategy == "retest" else ())
            frame = with_streaks(frame, streaks if early.strategy == "rsi" else ())
        frame = market_uptrend(with_ahead(frame, wait + hold).withColumn("next_earnings_ts", F.lit(None).cast("timestamp")), market, early.sma_trend).where("market_up")
        # Only what differs goes through columns.
        varied = [p for p in VARIED if len({getattr(c, p) for c in some}) > 1]
        early = replace(early, **{p: getattr(some[0], p) for p in VARIED if p not in varied})
        late = []
        for i in members:
            c = configs[i]
            at = lambda name, own=own[i]: own.get(name, F.col(name))
            params = [F.lit(getattr(c, p)).cast("int" if isinstance(getattr(StrategyConfig, p), int) else "double").alias(p) for p in varied]
            # For rsi the label decides, which needs the score.
            hit = F.lit(True) if c.strategy == "rsi" else F.coalesce(entry(c, at)[2], F.lit(False))
            late.append(F.struct(F.lit(i).alias("config_id"), hit.alias("hit"), *params, *(v.alias(k) for k, v in own[i].items())))
        cfg = replace(early, **{p: F.col("late")[p] for p in varied})
        frame = frame.withColumn("late", F.explode(F.filter(F.array(*late), lambda x: x["hit"]))).withColumns({k: F.col("late")[k] for k in own[members[0]]} or {"late": F.col("late")})
        part = fill_and_settle(candidates_in(frame, cfg, ("late",)).where(fires(cfg)), cfg, (F.col("late.config_id"),))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def successive_halving(bars: DataFrame, market: DataFrame, configs: dict[int, StrategyConfig], folds: DataFrame, rungs: int = 3, min_n: float = 15.0) -> DataFrame:
    """(config_id, rung, objective, drawdown): each rung doubles the share of folds and keeps the better half of the configurations.

    Rung r of `rungs` sees out-of-sample trades of the first 2^(r - rungs) of the folds and the bars
    up to their end only.  A configuration's row is that of the last rung it reached.
    Numbers of configurations and their scores are all that reaches the driver.
    """
    bounds = [(r["fold_id"], r["oos_start"], r["oos_end"]) for r in folds.orderBy("fold_id").select("fold_id", "oos_start", "oos_end").collect()]
    left, rows = dict(configs), []
    for rung in range(1, rungs + 1):
        seen = bounds[: max(1, len(bounds) >> (rungs - rung))]
        if not seen or not left:
            break
        start, end = min(b[1] for b in seen), max(b[2] for b in seen)
        slack = max(c.max_entry_wait + c.max_holding for c in left.values())
        part = sweep(until(bars, end, slack), market, left).where((F.col("signal_date") >= F.lit(start)) & (F.col("signal_date") < F.lit(end)))
        scores = {r["config_id"]: (r["objective"], r["drawdown"]) for r in score_configs(part, min_n).collect()}
        ranked = sorted(left, key=lambda i: (-scores.get(i, (-10.0, 100.0))[0], scores.get(i, (-10.0, 100.0))[1], i))
        keep = ranked if rung == rungs else ranked[: -(-len(ranked) // 2)]
        rows += [(i, rung, *map(float, scores.get(i, (-10.0, 100.0)))) for i in (ranked if rung == rungs else ranked[len(keep) :])]
        left = {i: left[i] for i in keep}
    return bars.sparkSession.createDataFrame(rows, "config_id int, rung int, objective double, drawdown double")


def until(bars: DataFrame, end, more: int) -> DataFrame:
    """Bars before `end` and the `more` bars of each ticker from then on, so that signals before it can be settled."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("bar_date"))
    later = bars.where(F.col("bar_date") >= F.lit(end)).withColumn("__k", k).where(F.col("__k") <= more).drop("__k")
    return bars.where(F.col("bar_date") < F.lit(end)).unionByName(later)


def score_configs(trades: DataFrame, min_n: float = 15.0) -> DataFrame:
    """Objective and drawdown of each configuration over its resolved trades, which are computed once."""
    key = ["config_id"]
    done = kept(trades.where("status <> 'OPEN'").select("config_id", "ticker", "sector", "signal_date", "entry_date", "status", "pnl_pct"))
    return kept(penalised(weighted_summary(cluster_weights(done, key), key).join(max_drawdown(done, key), key, "left"), min_n))


def pareto_front(scores: DataFrame) -> DataFrame:
    """Configurations that no other one dominates (objective not lower, drawdown not higher, one of them better).

    By window, not by comparing all pairs: in order of falling objective, one is
    dominated if a higher objective has a drawdown as low, or an equal one a lower.
    """
    by_level = scores.groupBy("objective").agg(F.min("drawdown").alias("__eq"))
    before = Window.orderBy(F.desc("objective")).rowsBetween(Window.unboundedPreceding, -1)
    by_level = by_level.withColumn("__up", F.min("__eq").over(before))
    return scores.join(by_level, "objective").where("(__up IS NULL OR __up > drawdown) AND drawdown <= __eq").select(*scores.columns)


def best_trial(scores: DataFrame, floor: float | None = None) -> DataFrame:
    ok = scores if floor is None else scores.where(F.col("objective") >= floor)
    return ok.orderBy(F.desc("objective"), "drawdown", "config_id").limit(1)


def compare_configs(bars: DataFrame, market: DataFrame, baseline: StrategyConfig, candidate: StrategyConfig) -> DataFrame:
    return summary(sweep(bars, market, {0: baseline, 1: candidate}), ["config_id"])
