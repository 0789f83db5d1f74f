"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import STRATEGIES, StrategyConfig
from ..operators import allocation, halo, incremental, indicators, joins, levels, metrics, scoring, selection, trades, verdicts
from ..sources import bars as B
from ..sources import layout, readers, tables, versions
from ..sources.shared import kept, scratch
from . import oracle as O

#: Shorter windows than the defaults, as the weekly bars of the test tables span some 300 weeks.
SMALL = StrategyConfig(
    ma_window=10, support_lookback=10, sma_trend=40, volume_lookback=10, min_dollar_volume=1_000_000.0, rsi_oversold=50.0, breakout_lookback=10, obv_window=10, bb_window=10,
    squeeze_window=20, pullback_ma=10, pullback_slope=5, pullback_band=10.0, retest_band=10.0, week52_lookback=100, week52_nearness=20.0,
)
CFG = {s: replace(SMALL, strategy=s) for s in STRATEGIES}
# The noise of the test prices keeps rsi scores low: wider brackets and lower labels give rows.
CFG["rsi"] = replace(CFG["rsi"], tp_mult=3.0, strong_buy_above=44.0, buy_from=43.0, watch_from=40.0)
SHARP = replace(CFG["breakout"], breakout_rsi_max=65.0, breakout_volume_ratio_min=0.8)
END, HALF_LIFE = "1998-12-01", 180.0
FOLD_START, FOLD_END = "1994-01-01", "1998-12-01"
SEED = "42"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return B.weekly_bars(spark, sf)


def market(spark: SparkSession, sf: str) -> DataFrame:
    return B.market_bars(spark, sf)


def earnings(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: every 13th bar date of a ticker, shifted by its nation's key."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("bar_date"))
    df = weekly(spark, sf).withColumn("k", k).join(B.universe(spark, sf).select("ticker", "nation_key"), "ticker")
    return df.where("(k + nation_key) % 13 = 0").select("ticker", F.col("bar_date").cast("timestamp").alias("earnings_ts"))


def frame(spark: SparkSession, sf: str, cfg: StrategyConfig = SMALL) -> DataFrame:
    return indicators.with_indicators(weekly(spark, sf), cfg, market(spark, sf))


def made(spark: SparkSession, sf: str, cfg: StrategyConfig, with_earnings: bool = False) -> DataFrame:
    return trades.make_trades(weekly(spark, sf), market(spark, sf), cfg, earnings(spark, sf) if with_earnings else None)


# Sources


@register("q_s02_history_scan", f"WITH {O.BARS} SELECT ticker, bar_date, open, high, low, close, volume FROM bars WHERE bar_date >= DATE '1996-01-01' - 420 AND bar_date < DATE '1997-01-01'")
def q_s02(spark, sf):
    return B.history(weekly(spark, sf), "1996-01-01", "1997-01-01").drop("sector")


@register("q_s01_trailing_year", f"WITH {O.BARS} SELECT ticker, bar_date, close FROM bars WHERE bar_date >= DATE '1996-06-30' - INTERVAL 12 MONTH AND bar_date <= DATE '1996-06-30'")
def q_s01(spark, sf):
    return B.trailing_year(weekly(spark, sf), "1996-06-30").select("ticker", "bar_date", "close")


@register("q_s03_trim_trailing", f"WITH {O.BARS}, n AS (SELECT *, CASE WHEN bar_date > DATE '1998-09-01' OR close > 60000 THEN NULL ELSE close END AS c FROM bars) SELECT ticker, bar_date, c AS close FROM n WHERE bar_date <= (SELECT max(m.bar_date) FROM n m WHERE m.ticker = n.ticker AND m.c IS NOT NULL)")
def q_s03(spark, sf):
    df = weekly(spark, sf).withColumn("close", F.when(~((F.col("bar_date") > F.lit("1998-09-01").cast("date")) | (F.col("close") > 60000)), F.col("close")))
    return B.trim_trailing(df).select("ticker", "bar_date", "close")


@register("q_s09_membership", f"WITH {O.BARS}, y AS (SELECT DISTINCT year(bar_date) AS y FROM bars) SELECT ticker FROM u WHERE n_nationkey % 7 <> (SELECT max(y) FROM y WHERE make_date(y, 1, 1) <= DATE '1996-05-05') % 7")
def q_s09(spark, sf):
    return readers.members_as_of(membership(spark, sf), "1996-05-05")


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: one snapshot a year, nations whose key modulo 7 differs from the year's."""
    years = weekly(spark, sf).select(F.year("bar_date").alias("y")).distinct()
    rows = years.join(B.universe(spark, sf), F.col("nation_key") % 7 != F.col("y") % 7)
    return rows.groupBy(F.make_date("y", F.lit(1), F.lit(1)).alias("snapshot_date")).agg(F.collect_list("ticker").alias("tickers"))


SPELLS = "sy AS (SELECT y, row_number() OVER (ORDER BY y) AS k FROM (SELECT DISTINCT year(bar_date) AS y FROM bars)), sm AS (SELECT ticker, k, k - row_number() OVER (PARTITION BY ticker ORDER BY k) AS run FROM u JOIN sy ON n_nationkey % 7 <> y % 7), sp AS (SELECT ticker, CASE WHEN min(k) > 1 THEN make_date((SELECT y FROM sy WHERE sy.k = min(sm.k)), 1, 1) END AS member_from, make_date((SELECT y FROM sy WHERE sy.k = max(sm.k) + 1), 1, 1) AS member_until FROM sm GROUP BY ticker, run)"


@register("q_s09_membership_spells", f"WITH {O.BARS}, {SPELLS} SELECT * FROM sp")
def q_s09_spells(spark, sf):
    """Snapshots written as a CSV file, loaded, and put together as spells."""
    path = scratch(spark)
    tables.export_csv(membership(spark, sf).select(F.col("snapshot_date").alias("date"), F.array_join(F.array_sort("tickers"), ",").alias("tickers")), path)
    return readers.membership_spells(readers.read_membership(spark, path))


# Indicators

F1 = O.base(SMALL)


def indicator(name: str, columns: list[str], sql_columns: str | None = None):
    sql = ", ".join(f"round({c}, 6) AS {c}" if c not in ("support_date", "breakout_flag", "days_since_breakout", "oversold_streak_days", "extended_decline_warning") else c for c in columns)

    @register(name, f"{F1} SELECT ticker, bar_date, {sql_columns or sql} FROM f")
    def q(spark, sf):
        return rounded(frame(spark, sf).select("ticker", "bar_date", *columns))

    return q


indicator("q_w01_averages", ["sma", "sma_trend", "avg_volume", "avg_volume_prior"])
indicator("q_w04_highs", ["highest_high", "week52_high"])
indicator("q_w06_support", ["support_level", "support_date"])
indicator("q_w07_rsi", ["rsi"])
indicator("q_w08_atr", ["atr"])
indicator("q_w09_adx", ["adx"])
indicator("q_w11_streak", ["oversold_streak_days", "extended_decline_warning"], f"oversold_streak_days::INT AS oversold_streak_days, oversold_streak_days >= {SMALL.decline_days} AS extended_decline_warning")
indicator("q_w13_obv", ["obv", "obv_zscore"])
indicator("q_w15_squeeze", ["volatility", "squeeze_zscore"])
indicator("q_w17_relative_strength", ["k_return", "relative_strength"])
indicator("q_w19_volume_ratio", ["volume_ratio"])
indicator("q_w20_pullback_slope", ["ma_pullback", "ma_pullback_prior"])
indicator("q_w21_breakout_state", ["breakout_flag", "last_breakout_level", "days_since_breakout"], "breakout_flag, round(last_breakout_level, 6) AS last_breakout_level, days_since_breakout::INT AS days_since_breakout")


@register("q_w24_latest", f"{F1} SELECT ticker, bar_date, close, round(rsi, 6) AS rsi FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) = 1")
def q_w24(spark, sf):
    return rounded(indicators.latest(frame(spark, sf)).select("ticker", "bar_date", "close", "rsi"))


# Short memories, so that spans of some hundred bars are longer than the look-back.
SPANS = replace(SMALL, rsi_window=3, atr_window=3, adx_window=3, week52_lookback=60)
SPAN_COLUMNS = ["rn", "sma", "sma_trend", "avg_volume_prior", "highest_high", "week52_high", "support_level", "rsi", "atr", "adx", "obv", "obv_zscore", "squeeze_zscore", "ma_pullback_prior", "last_breakout_level"]
#: Means of prices have ties at fewer than six digits, sums of many terms differ beyond four.
SPAN_DIGITS = {"atr": 4, "squeeze_zscore": 4}
SUPPLIER_BARS = f"u AS (SELECT 1), bars AS (SELECT l_suppkey::VARCHAR AS ticker, NULL::VARCHAR AS sector, l_shipdate::DATE AS bar_date, {O.AGGREGATES} FROM lineitem GROUP BY ALL), mbars AS (SELECT l_shipdate::DATE AS bar_date, {O.AGGREGATES} FROM lineitem GROUP BY 1)"


@register("q_w25_indicators_by_span", f"WITH {SUPPLIER_BARS}, {O.frame(SPANS)} SELECT ticker, bar_date, {', '.join(f'round({c}, {SPAN_DIGITS.get(c, 6)}) AS {c}' if c != 'rn' else c for c in SPAN_COLUMNS)}, days_since_breakout::INT AS days_since_breakout, oversold_streak_days::INT AS oversold_streak_days FROM f")
def q_w25(spark, sf):
    # All prices of a bar are of the same lines, so one with a close has the others.
    df = B.daily_supplier_bars_by_year(spark, sf).drop("open")
    out = halo.with_indicators_by_span(df, SPANS, span=200, whole_bars=True)
    return out.select("ticker", "bar_date", *(F.round(c, SPAN_DIGITS.get(c, 6)).alias(c) if c != "rn" else F.col(c) for c in SPAN_COLUMNS), "days_since_breakout", "oversold_streak_days")


STATE_DIGITS = {"atr": 4}
STATE_ROWS = [c for c in incremental.ROW if c not in ("rn", "oversold_streak_days", "days_since_breakout")]


@register("q_w26_incremental_update", f"{F1} SELECT ticker, bar_date, rn, oversold_streak_days::INT AS oversold_streak_days, days_since_breakout::INT AS days_since_breakout, {', '.join(f'round({c}, {STATE_DIGITS.get(c, 6)}) AS {c}' for c in STATE_ROWS)} FROM f WHERE bar_date >= DATE '1998-03-01'")
def q_w26(spark, sf):
    """The state after the bars before a day, moved on by the bars since then."""
    b = kept(weekly(spark, sf))
    day = F.lit("1998-03-01").cast("date")
    moved = incremental.advance(incremental.state_after(b.where(F.col("bar_date") < day), SMALL), b.where(F.col("bar_date") >= day), SMALL)
    return incremental.rows_of(moved).select("ticker", "bar_date", "rn", "oversold_streak_days", "days_since_breakout", *(F.round(c, STATE_DIGITS.get(c, 6)).alias(c) for c in STATE_ROWS))


def laid_out(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly bars as a bucketed table of this session."""
    table = f"bars_{uuid.uuid4().hex}"
    bars = kept(weekly(spark, sf))
    layout.save_bars(bars, table, layout.buckets_for(bars.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return layout.read_bars(spark, table)


@register("q_d02_bucketed_adx", f"{F1} SELECT ticker, bar_date, round(adx, 6) AS adx, round(atr, 4) AS atr FROM f")
def q_d02(spark, sf):
    df = indicators.adx(laid_out(spark, sf), SMALL.adx_window, atr_out="atr")
    return df.select("ticker", "bar_date", F.round("adx", 6).alias("adx"), F.round("atr", 4).alias("atr"))


@register("q_m0_breakouts_in_uptrend", f"{F1} SELECT ticker, bar_date, close, highest_high, round(sma_trend, 6) AS sma_trend FROM f WHERE breakout_flag AND close >= sma_trend")
def q_m0(spark, sf):
    return rounded(indicators.with_indicators(weekly(spark, sf), SMALL).where("breakout_flag AND close >= sma_trend").select("ticker", "bar_date", "close", "highest_high", "sma_trend"))


# Gates, levels, scores


@register("q_p02_market_gate", f"{F1} SELECT ticker, f.bar_date, market_up FROM f JOIN mk ON mk.bar_date = f.bar_date")
def q_p02(spark, sf):
    return joins.market_uptrend(weekly(spark, sf), market(spark, sf), SMALL.sma_trend).select("ticker", "bar_date", "market_up")


@register("q_p06_catalyst", f"WITH {O.BARS}, {O.EARNINGS} SELECT ticker, bar_date, (SELECT min(e.earnings_ts) FROM earnings e WHERE e.ticker = b.ticker AND e.earnings_ts >= b.bar_date::TIMESTAMP)::DATE AS next_earnings_date, coalesce((SELECT min(e.earnings_ts) FROM earnings e WHERE e.ticker = b.ticker AND e.earnings_ts >= b.bar_date::TIMESTAMP) <= b.bar_date::TIMESTAMP + INTERVAL 14 DAY, false) AS catalyst_warning FROM bars b")
def q_p06(spark, sf):
    df = joins.next_earnings(weekly(spark, sf), earnings(spark, sf))
    return df.select("ticker", "bar_date", F.to_date("next_earnings_ts").alias("next_earnings_date"), joins.catalyst_warning(14).alias("catalyst_warning"))


@register("q_p03_exclusions", f"{F1}, {O.levels(CFG['rsi'])} SELECT exclude_reason AS reason, count(*)::BIGINT AS n FROM lv WHERE exclude_reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'no bars', count(*) FROM u WHERE ticker NOT IN (SELECT ticker FROM bars) HAVING count(*) > 0")
def q_p03(spark, sf):
    rows = levels.levels(frame(spark, sf, CFG["rsi"]), CFG["rsi"])
    return levels.skip_list(rows, B.universe(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


def _levels(i: int, strategy: str):
    cfg = CFG[strategy]
    own = ", ".join(levels.OWN[strategy])

    @register(f"q_p{i:02d}_{strategy}_levels", f"{O.base(cfg)}, {O.levels(cfg)} SELECT ticker, sector, as_of, strategy, last_close, rsi, atr, buy_price, sell_price, stop_loss, rrr, distance_to_buy_pct, trigger, exclude_reason, {own} FROM lv")
    def q(spark, sf):
        return rounded(levels.levels(frame(spark, sf, cfg), cfg))

    @register(f"q_c{i - 6:02d}_{strategy}_scores", f"{O.base(cfg)}, {O.levels(cfg)}, {O.scores(cfg)} SELECT ticker, as_of, trade_score, signal FROM sc")
    def q2(spark, sf):
        return scoring.scored(levels.levels(frame(spark, sf, cfg), cfg), cfg).select("ticker", "as_of", "trade_score", "signal")


for _i, _s in enumerate(STRATEGIES):
    _levels(7 + _i, _s)


@register("q_p13_dispatch", " UNION ALL ".join(f"(SELECT * FROM ({O.base(CFG[s])}, {O.levels(CFG[s])}, {O.scores(CFG[s])} SELECT strategy, signal, count(*)::BIGINT AS n FROM sc GROUP BY ALL))" for s in STRATEGIES))
def q_p13(spark, sf):
    out = scoring.scored(levels.dispatch(frame(spark, sf), list(CFG.values())), *CFG.values())
    return out.groupBy("strategy", "signal").agg(F.count("*").alias("n"))


@register("q_p14_breakout_filters", f"{O.base(SHARP)}, {O.levels(SHARP)}, {O.scores(SHARP)} SELECT ticker, as_of, trade_score, signal FROM sc WHERE fires")
def q_p14(spark, sf):
    return scoring.scored(levels.levels(frame(spark, sf, SHARP), SHARP), SHARP).where(trades.fires(SHARP)).select("ticker", "as_of", "trade_score", "signal")


@register("q_p17_loosened_only", f"WITH t AS ({O.base(SHARP)}, {O.levels(SHARP)}, {O.scores(SHARP)} SELECT * FROM sc), l AS ({O.base(SHARP.loosened())}, {O.levels(SHARP.loosened())}, {O.scores(SHARP.loosened())} SELECT * FROM sc) SELECT l.ticker, l.as_of, l.signal, l.trade_score FROM l JOIN t ON t.ticker = l.ticker AND t.as_of = l.as_of AND t.signal = 'Ignore' WHERE l.signal IN ('Strong Buy', 'Buy', 'Watch')")
def q_p17(spark, sf):
    rows = levels.levels(frame(spark, sf, SHARP), SHARP)  # the same windows under both configurations
    return scoring.loosened_only(scoring.scored(rows, SHARP), scoring.scored(rows, SHARP.loosened())).select("ticker", "as_of", "signal", "trade_score")


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: nations with an even key, 500 a key, at their mean close."""
    cost = weekly(spark, sf).groupBy("ticker").agg(F.round(F.avg("close"), 2).alias("avg_cost"))
    return B.universe(spark, sf).where("nation_key % 2 = 0").join(cost, "ticker").select("ticker", "sector", (F.col("nation_key") + 1).cast("double").alias("k"), "avg_cost").withColumn("amount", F.col("k") * 500).drop("k")


HOLD = "h AS (SELECT u.ticker, u.sector, (n_nationkey + 1) * 500.0::DOUBLE AS amount, (SELECT round(avg(close), 2) FROM bars b WHERE b.ticker = u.ticker) AS avg_cost FROM u WHERE n_nationkey % 2 = 0 AND EXISTS (SELECT 1 FROM bars b WHERE b.ticker = u.ticker))"


@register("q_p16_holding_review", f"{F1}, {HOLD}, x AS (SELECT h.*, f.bar_date AS as_of, f.close, f.atr AS a FROM h JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) = 1) f ON f.ticker = h.ticker WHERE f.atr IS NOT NULL), y AS (SELECT *, {O.rnd('avg_cost - a * 1.0', 2)} AS stop_loss, {O.rnd('avg_cost + a * 1.5', 2)} AS sell_price FROM x) SELECT ticker, as_of, {O.rnd('avg_cost', 2)} AS avg_cost, {O.rnd('close', 2)} AS last_close, {O.rnd('a', 2)} AS atr, stop_loss, sell_price, {O.rnd('(close - avg_cost) / avg_cost * 100', 2)} AS unrealized_pnl_pct, CASE WHEN close <= stop_loss THEN 'SELL (stop breached)' WHEN close >= sell_price THEN 'SELL (target hit)' ELSE 'HOLD' END AS recommendation FROM y")
def q_p16(spark, sf):
    return levels.review_holdings(holdings(spark, sf), frame(spark, sf), SMALL)


# Trades

TRADE_COLUMNS = "ticker, sector, strategy, signal_date, entry_date, signal, atr, buy_price, signal_buy_price, stop_loss, sell_price, catalyst_warning, status, exit_price, exit_reason, holding_days, pnl_pct, exit_date"


def _trades(i: int, strategy: str):
    cfg = CFG[strategy]
    extra = ", trade_score, rsi, rrr" if strategy == "rsi" else ""

    @register(f"q_t{i:02d}_{strategy}_trades", f"{O.trades(cfg, True)} SELECT {TRADE_COLUMNS}{extra} FROM tr")
    def q(spark, sf):
        return made(spark, sf, cfg, True)


for _i, _s in enumerate(STRATEGIES):
    _trades(1 + _i, _s)


def _random(strategy: str):
    cfg = CFG[strategy]
    sql = f"{O.trades(cfg)}, wanted AS (SELECT ticker, count(*) AS n FROM tr GROUP BY 1), picks AS (SELECT g.* FROM g JOIN wanted USING (ticker) QUALIFY row_number() OVER (PARTITION BY g.ticker ORDER BY md5(g.ticker || '|' || g.as_of::VARCHAR || '|{SEED}')) <= any_value(n) OVER (PARTITION BY g.ticker)), {O.settled(cfg, 'picks', 'rt')}"

    @register(f"q_t07_random_{strategy}", f"{sql} SELECT {TRADE_COLUMNS} FROM rt")
    def q(spark, sf):
        return trades.random_baseline(weekly(spark, sf), market(spark, sf), cfg, SEED).select(*TRADE_COLUMNS.split(", "))

    return sql


RANDOM_SQL = {s: _random(s) for s in STRATEGIES}
PULL = CFG["pullback"]
TR = O.trades(PULL)


@register("q_t08_universe_trades", " UNION ALL ".join(f"(SELECT * FROM ({O.trades(CFG[s])} SELECT strategy, status, count(*)::BIGINT AS n, round(sum(pnl_pct), 4) AS total FROM tr GROUP BY ALL))" for s in STRATEGIES))
def q_t08(spark, sf):
    df = trades.universe_trades(weekly(spark, sf), market(spark, sf), list(CFG.values()))
    return df.groupBy("strategy", "status").agg(F.count("*").alias("n"), F.round(F.sum("pnl_pct"), 4).alias("total"))


FOLDS = f"fold AS (SELECT (row_number() OVER (ORDER BY s) - 1)::INT AS fold_id, s::DATE AS is_start, s::DATE + 182 AS is_end, s::DATE + 182 AS oos_start, s::DATE + 212 AS oos_end FROM (SELECT z, unnest(generate_series(a, z, INTERVAL 30 DAY)) AS s FROM (SELECT min(bar_date) AS a, max(bar_date) + 1 AS z FROM bars WHERE bar_date >= DATE '{FOLD_START}' AND bar_date < DATE '{FOLD_END}')) WHERE s::DATE + 212 <= z)"


def fold_table(spark: SparkSession, sf: str) -> DataFrame:
    return trades.folds(weekly(spark, sf), FOLD_START, FOLD_END)


@register("q_t09_folds", f"WITH {O.BARS}, {FOLDS} SELECT * FROM fold")
def q_t09(spark, sf):
    return fold_table(spark, sf)


FT = f"{TR}, {FOLDS}, ft AS (SELECT fold_id, 'is' AS sample, oos_end, tr.* FROM tr JOIN fold ON signal_date >= is_start AND signal_date < is_end UNION ALL SELECT fold_id, 'oos', oos_end, tr.* FROM tr JOIN fold ON signal_date >= oos_start AND signal_date < oos_end)"


@register("q_t10_walk_forward", f"{FT} {O.summary('ft', 'fold_id, sample')}")
def q_t10(spark, sf):
    return rounded(metrics.summary(joins.assign_folds(made(spark, sf, PULL), fold_table(spark, sf)), ["fold_id", "sample"]))


OTHER = replace(PULL, tp_mult=2.0, sl_mult=0.5)


@register("q_t11_compare_configs", f"WITH c0 AS ({O.summary('(' + TR + ' SELECT * FROM tr)')}), c1 AS ({O.summary('(' + O.trades(OTHER) + ' SELECT * FROM tr)')}) SELECT 0 AS config_id, * FROM c0 UNION ALL SELECT 1, * FROM c1")
def q_t11(spark, sf):
    return rounded(selection.compare_configs(weekly(spark, sf), market(spark, sf), PULL, OTHER))


GRID = selection.grid(PULL, tp_mult=[1.0, 1.5, 2.0], sl_mult=[0.5, 1.0])


def trades_of(configs: dict[int, StrategyConfig]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS config_id, ticker, sector, signal_date, entry_date, status, pnl_pct FROM ({O.trades(c)} SELECT * FROM tr)" for i, c in configs.items())


def score_ctes(source: str, k: str = "") -> str:
    """Objective and drawdown of each configuration of a trades CTE, as CTE sc{k}."""
    draw = f"SELECT config_id, round_even(max((peak - eq) / peak) * 100 * 100, 0) / 100 AS dd FROM (SELECT *, greatest(1.0, max(eq) OVER (PARTITION BY config_id ORDER BY entry_date, ticker, signal_date)) AS peak FROM (SELECT *, exp(sum(ln(1 + pnl_pct / 100)) OVER (PARTITION BY config_id ORDER BY entry_date, ticker, signal_date)) AS eq FROM {source} WHERE status <> 'OPEN')) GROUP BY 1"
    return f"gw{k} AS ({O.clustered(source, 'config_id')}), gs{k} AS ({O.weighted(f'gw{k}', 'config_id')}), gd{k} AS ({draw}), sc{k} AS (SELECT config_id, CASE WHEN coalesce(kish_n, 0) < 15 OR w_sharpe_like IS NULL THEN -10.0 ELSE w_sharpe_like END AS objective, CASE WHEN coalesce(kish_n, 0) < 15 OR w_sharpe_like IS NULL THEN 100.0 ELSE dd END AS drawdown FROM gs{k} JOIN gd{k} USING (config_id))"


def grid_scores_sql() -> str:
    return f"WITH gt AS ({trades_of(GRID)}), {score_ctes('gt')}"


def grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = selection.score_configs(selection.sweep(*B.panel(spark, sf), GRID))
    return rounded(df.select("config_id", "objective", "drawdown"))


@register("q_t12_sweep", f"{grid_scores_sql()} SELECT config_id, objective, drawdown FROM sc")
def q_t12(spark, sf):
    return grid_scores(spark, sf)


@register("q_r06_pareto_front", f"{grid_scores_sql()} SELECT * FROM sc a WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.objective >= a.objective AND b.drawdown <= a.drawdown AND (b.objective > a.objective OR b.drawdown < a.drawdown))")
def q_r06(spark, sf):
    return selection.pareto_front(grid_scores(spark, sf))


@register("q_r07_best_trial", f"{grid_scores_sql()} SELECT * FROM sc ORDER BY objective DESC, drawdown, config_id LIMIT 1")
def q_r07(spark, sf):
    return selection.best_trial(grid_scores(spark, sf))


# All lengths in one frame, and searches over all bounds

LENGTHS = {n: replace(CFG["breakout"], breakout_lookback=n) for n in range(10, 81)} | {100 + n: replace(PULL, pullback_ma=n) for n in range(10, 51)}


def lengths_sql(cfg: StrategyConfig, ids: int, low: int, high: int, value: str) -> str:
    """Trades for each length from low to high: a ticker's bars are repeated for each length, with the window's value by a join of bars with bars."""
    x = "(SELECT f.* EXCLUDE (ticker, highest_high, ma_pullback, ma_pullback_prior), f.ticker || '#' || v.n AS ticker, v.* EXCLUDE (ticker, rn, n) FROM f JOIN v ON v.ticker = f.ticker AND v.rn = f.rn)"
    values = f"v AS (SELECT a.ticker, a.rn, n, {value} FROM a1 a CROSS JOIN range({low}, {high + 1}) l(n) JOIN a1 b ON b.ticker = a.ticker AND b.rn BETWEEN a.rn - n - {cfg.pullback_slope} AND a.rn GROUP BY a.ticker, a.rn, n)"
    body = f"{O.levels(cfg)}, {O.scores(cfg)}".replace("exclude_reason FROM f)", f"exclude_reason FROM {x} f)")
    body = f"{O.base(cfg)}, {values}, a1x AS (SELECT * REPLACE (ticker || '#' || n AS ticker) FROM a1 CROSS JOIN range({low}, {high + 1}) l(n)), {body}, {O.gated(cfg).rpartition(', g AS ')[1][2:]}{O.gated(cfg).rpartition(', g AS ')[2]}, fire AS (SELECT * FROM g WHERE fires), {O.settled(cfg, 'fire').replace('a1 b', 'a1x b')}"
    return f"SELECT {ids} + split_part(ticker, '#', 2)::INT AS config_id, count(*)::BIGINT AS n, round(sum(pnl_pct), 4) AS total FROM ({body} SELECT * FROM tr) GROUP BY 1"


HIGHS_SQL = lengths_sql(CFG["breakout"], 0, 10, 80, "CASE WHEN count(b.high) FILTER (WHERE b.rn >= a.rn - n AND b.rn < a.rn) = n THEN max(b.high) FILTER (WHERE b.rn >= a.rn - n AND b.rn < a.rn) END AS highest_high, NULL::DOUBLE AS ma_pullback, NULL::DOUBLE AS ma_pullback_prior")
MEAN_OF = "CASE WHEN count(b.close) FILTER (WHERE b.rn > a.rn - n - {k} AND b.rn <= a.rn - {k}) = n THEN (sum(b.close::DECIMAL(28, 10)) FILTER (WHERE b.rn > a.rn - n - {k} AND b.rn <= a.rn - {k}))::DOUBLE / n END"
MEANS_SQL = lengths_sql(PULL, 100, 10, 50, f"NULL::DOUBLE AS highest_high, {MEAN_OF.format(k=0)} AS ma_pullback, {MEAN_OF.format(k=PULL.pullback_slope)} AS ma_pullback_prior")


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("config_id").agg(F.count("*").alias("n"), F.round(F.sum("pnl_pct"), 4).alias("total"))


@register("q_t12_all_lengths", f"({HIGHS_SQL}) UNION ALL ({MEANS_SQL})")
def q_t12_lengths(spark, sf):
    return totals(selection.sweep(*B.panel(spark, sf), LENGTHS))


POINTS = {s: selection.search_points(CFG[s], 24 if s == "breakout" else 12 if s == "rsi" else 8, 7) for s in STRATEGIES}


def _search(strategy: str):
    sql = " UNION ALL ".join(f"(SELECT {i} AS config_id, count(*)::BIGINT AS n, round(sum(pnl_pct), 4) AS total FROM ({O.trades(c)} SELECT * FROM tr) HAVING count(*) > 0)" for i, c in POINTS[strategy].items())

    @register(f"q_t13_search_{strategy}", sql)
    def q(spark, sf):
        return totals(selection.sweep(*B.panel(spark, sf), POINTS[strategy]))


for _s in STRATEGIES:
    _search(_s)


MIXED = {100 * k + i: c for k, s in enumerate(("pullback", "retest", "week52")) for i, c in POINTS[s].items()}
MIXED_SQL = f"WITH gt AS MATERIALIZED ({trades_of(MIXED)}), {score_ctes('gt')}"
FRONT_SQL = "SELECT config_id, objective, drawdown FROM sc a WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.objective >= a.objective AND b.drawdown <= a.drawdown AND (b.objective > a.objective OR b.drawdown < a.drawdown))"


def mixed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.score_configs(selection.sweep(*B.panel(spark, sf), MIXED)).select("config_id", "objective", "drawdown"))


@register("q_r06_search_front", f"{MIXED_SQL} {FRONT_SQL}")
def q_r06_search(spark, sf):
    return selection.pareto_front(mixed_scores(spark, sf))


@register("q_r07_search_best", f"{MIXED_SQL} SELECT config_id, objective, drawdown FROM sc WHERE objective >= -5 ORDER BY objective DESC, drawdown, config_id LIMIT 1")
def q_r07_search(spark, sf):
    return selection.best_trial(mixed_scores(spark, sf), floor=-5.0)


def halving_sql(configs: dict[int, StrategyConfig], rungs: int = 3) -> str:
    ctes = [f"gt AS MATERIALIZED ({trades_of(configs)})", O.BARS, FOLDS, "al0 AS (SELECT unnest([" + ", ".join(map(str, configs)) + "]) AS config_id)"]
    parts = []
    for r in range(1, rungs + 1):
        ctes.append(f"gt{r} AS (SELECT gt.* FROM gt JOIN al{r - 1} USING (config_id), (SELECT min(oos_start) AS a, max(oos_end) AS z FROM fold WHERE fold_id < greatest(1, (SELECT count(*) FROM fold) >> {rungs - r})) w WHERE signal_date >= a AND signal_date < z)")
        ctes.append(score_ctes(f"gt{r}", str(r)))
        ctes.append(f"rk{r} AS (SELECT config_id, coalesce(objective, -10.0) AS objective, coalesce(drawdown, 100.0) AS drawdown, row_number() OVER (ORDER BY coalesce(objective, -10.0) DESC, coalesce(drawdown, 100.0), config_id) AS k, count(*) OVER () AS m FROM al{r - 1} LEFT JOIN sc{r} USING (config_id))")
        ctes.append(f"al{r} AS (SELECT config_id FROM rk{r} WHERE k <= (m + 1) // 2)")
        parts.append(f"SELECT config_id, {r} AS rung, objective, drawdown FROM rk{r}" + (" WHERE k > (m + 1) // 2" if r < rungs else ""))
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@register("q_t13_halving", halving_sql(POINTS["pullback"]))
def q_t13_halving(spark, sf):
    return rounded(selection.successive_halving(*B.panel(spark, sf), POINTS["pullback"], fold_table(spark, sf)))


@register("q_t15_sample_tickers", f"WITH {O.BARS} SELECT ticker FROM (SELECT DISTINCT ticker FROM u) ORDER BY md5(ticker || '|{SEED}') LIMIT 8")
def q_t15(spark, sf):
    return selection.sample_tickers(B.universe(spark, sf), 8, SEED)


HO = f"ho AS (SELECT ticker, sector, row_number() OVER (PARTITION BY sector ORDER BY md5(ticker || '|{SEED}')) <= round_even(count(*) OVER (PARTITION BY sector) * 0.25, 0) AS holdout FROM u)"


@register("q_t16_stratified_holdout", f"WITH {O.BARS}, {HO} SELECT * FROM ho")
def q_t16(spark, sf):
    return selection.stratified_holdout(B.universe(spark, sf), 0.25, SEED)


@register("q_t17_real_vs_random", f"WITH rr AS ({RANDOM_SQL['pullback']}, {HO} SELECT x.*, ho.holdout FROM (SELECT 'real' AS cohort, ticker, sector, entry_date, status, pnl_pct FROM tr UNION ALL SELECT 'random', ticker, sector, entry_date, status, pnl_pct FROM rt) x LEFT JOIN ho USING (ticker)), sp AS (SELECT *, unnest(['all', CASE WHEN coalesce(holdout, false) THEN 'holdout' ELSE 'tune' END]) AS split FROM rr), cw AS ({O.clustered('sp', 'cohort, split')}) {O.weighted('cw', 'cohort, split')}")
def q_t17(spark, sf):
    b, m = B.panel(spark, sf)
    return rounded(selection.cohort_table(trades.make_trades(b, m, PULL), trades.random_baseline(b, m, PULL, SEED), selection.stratified_holdout(B.universe(spark, sf), 0.25, SEED)))


US = f"""WITH tt AS ({TR}, y AS (SELECT DISTINCT year(bar_date) AS y FROM bars), mem AS (SELECT ticker FROM u WHERE n_nationkey % 7 <> (SELECT max(y) FROM y WHERE make_date(y, 1, 1) <= DATE '1996-05-05') % 7), wl AS (SELECT ticker FROM (SELECT DISTINCT ticker FROM u) ORDER BY md5(ticker || '|{SEED}') LIMIT 8)
SELECT 'watchlist' AS universe_id, tr.* FROM tr JOIN wl USING (ticker) UNION ALL SELECT 'members', tr.* FROM tr JOIN mem USING (ticker)), us AS ({O.summary('tt', 'universe_id')})"""


def universe_summaries(spark: SparkSession, sf: str) -> DataFrame:
    tr = made(spark, sf, PULL)
    pick = selection.sample_tickers(B.universe(spark, sf), 8, SEED).withColumn("universe_id", F.lit("watchlist")).union(readers.members_as_of(membership(spark, sf), "1996-05-05").withColumn("universe_id", F.lit("members")))
    return rounded(metrics.summary(tr.join(pick, "ticker"), ["universe_id"]))


@register("q_t14_universes", f"{US} SELECT * FROM us")
def q_t14(spark, sf):
    return universe_summaries(spark, sf)


@register("q_j03_members_over_time", f"{TR}, {SPELLS}, mt AS (SELECT tr.*, year(signal_date)::INT AS year FROM tr JOIN sp ON sp.ticker = tr.ticker AND (member_from IS NULL OR member_from <= signal_date) AND (member_until IS NULL OR signal_date < member_until)) {O.summary('mt', 'year')}")
def q_j03(spark, sf):
    """Trades of those that were members on the day of the signal, by year."""
    b, m = B.panel(spark, sf)
    members = joins.members_then(trades.make_trades(b, m, PULL), readers.membership_spells(membership(spark, sf)), "signal_date")
    return rounded(metrics.summary(members.withColumn("year", F.year("signal_date")), ["year"]))


@register("q_t14_universes_over_time", f"{TR}, {SPELLS}, wl AS (SELECT ticker FROM (SELECT DISTINCT ticker FROM u) ORDER BY md5(ticker || '|{SEED}') LIMIT 8), tt AS (SELECT 'watchlist' AS universe_id, tr.* FROM tr JOIN wl USING (ticker) UNION ALL SELECT 'members', tr.* FROM tr JOIN sp ON sp.ticker = tr.ticker AND (member_from IS NULL OR member_from <= signal_date) AND (member_until IS NULL OR signal_date < member_until)) {O.summary('tt', 'universe_id')}")
def q_t14_over_time(spark, sf):
    """A sample of the watchlist of today against those that were members at the time."""
    b, m = B.panel(spark, sf)
    tr = kept(trades.make_trades(b, m, PULL))
    today = tr.join(selection.sample_tickers(B.universe(spark, sf), 8, SEED), "ticker", "left_semi").withColumn("universe_id", F.lit("watchlist"))
    then = joins.members_then(tr, readers.membership_spells(membership(spark, sf)), "signal_date").withColumn("universe_id", F.lit("members"))
    return rounded(metrics.summary(today.unionByName(then), ["universe_id"]))


@register("q_g16_universe_delta", f"{US} SELECT round(max(win_rate_pct) FILTER (WHERE universe_id = 'watchlist') - max(win_rate_pct) FILTER (WHERE universe_id = 'members'), 5) AS win_rate_delta, round(coalesce(max(sharpe_like) FILTER (WHERE universe_id = 'watchlist'), 0) - coalesce(max(sharpe_like) FILTER (WHERE universe_id = 'members'), 0), 5) AS sharpe_delta FROM us")
def q_g16(spark, sf):
    return rounded(metrics.universe_delta(universe_summaries(spark, sf), "watchlist", "members"), 5)


@register("q_u03_missing_tickers", f"WITH {O.BARS} SELECT DISTINCT ticker FROM u WHERE ticker NOT IN (SELECT ticker FROM bars WHERE bar_date < DATE '1995-02-06' AND volume > 150)")
def q_u03(spark, sf):
    early = weekly(spark, sf).where("bar_date < date'1995-02-06' AND volume > 150").select("ticker").distinct()
    return B.universe(spark, sf).select("ticker").distinct().join(early, "ticker", "left_anti")


# Statistics


@register("q_g01_summary", f"{TR} {O.summary('tr')}")
def q_g01(spark, sf):
    return rounded(metrics.summary(made(spark, sf, PULL)))


@register("q_g02_cluster_weights", f"{TR}, cw AS ({O.clustered('tr')}) SELECT ticker, signal_date, entry_date, sector, round(weight, 6) AS weight FROM cw")
def q_g02(spark, sf):
    return rounded(metrics.cluster_weights(made(spark, sf, PULL).where("status <> 'OPEN'")).select("ticker", "signal_date", "entry_date", "sector", "weight"))


@register("q_g03_weighted_summary", f"{TR}, cw AS ({O.clustered('tr')}), w AS ({O.weighted('cw')}) SELECT *, round((1 - kish_n / n) * 100, 4) AS inflation_pct FROM w")
def q_g03(spark, sf):
    df = metrics.weighted_summary(metrics.cluster_weights(made(spark, sf, PULL).where("status <> 'OPEN'")))
    return metrics.inflation_pct(rounded(df)).withColumn("inflation_pct", F.round("inflation_pct", 4))


@register("q_g05_recency_weighted", f"{FT}, pw AS (SELECT * REPLACE (weight * pow(0.5, greatest(date_diff('day', oos_end, DATE '{END}'), 0) / {HALF_LIFE}) AS weight) FROM ({O.clustered('ft WHERE sample = $$oos$$ AND pnl_pct IS NOT NULL').replace('WHERE status <>', 'AND status <>')})) {O.weighted('pw')}")
def q_g05(spark, sf):
    return rounded(metrics.pooled_weighted(joins.assign_folds(made(spark, sf, PULL), fold_table(spark, sf)), END, HALF_LIFE))


@register("q_g06_by_catalyst", f"{O.trades(PULL, True)} {O.summary('tr', 'catalyst_warning')}")
def q_g06(spark, sf):
    return rounded(metrics.by_catalyst(made(spark, sf, PULL, True)))


@register("q_g07_max_drawdown", f"{TR} SELECT strategy, round_even(max((peak - eq) / peak) * 100 * 100, 0) / 100 AS max_drawdown_pct FROM (SELECT *, greatest(1.0, max(eq) OVER (ORDER BY entry_date, ticker, signal_date)) AS peak FROM (SELECT *, exp(sum(ln(1 + pnl_pct / 100)) OVER (ORDER BY entry_date, ticker, signal_date)) AS eq FROM tr WHERE status <> 'OPEN')) GROUP BY 1")
def q_g07(spark, sf):
    return metrics.max_drawdown(made(spark, sf, PULL), ["strategy"])


# Stored signals

RSI = CFG["rsi"]
DAY = "1996-06-03"
STORED = f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)}, st AS (SELECT ticker, as_of AS signal_date, strategy, signal, CASE WHEN signal IN ('Strong Buy', 'Buy') THEN 'actionable' ELSE 'research' END AS tier, trade_score, buy_price, stop_loss, sell_price, extended_decline_warning FROM sc WHERE signal IN ('Strong Buy', 'Buy', 'Watch'))"


def stored_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: all loggable rsi rows, with their configuration."""
    rows = tables.tiered(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI))
    config = F.struct(F.lit(RSI.max_holding).alias("max_holding"), F.lit(RSI.slippage).alias("slippage"), F.lit(RSI.commission).alias("commission"))
    return rows.select("ticker", F.col("as_of").alias("signal_date"), "strategy", "signal", "tier", "trade_score", "buy_price", "stop_loss", "sell_price", F.lit(False).alias("settled"), F.lit(None).cast("boolean").alias("confirmed_filled"), F.lit(None).cast("double").alias("fill_price"), config.alias("config"))


SETTLED = f"""{STORED}, s4 AS (SELECT st.*, b.k, b.bd, CASE WHEN b.open <= stop_loss THEN 1 WHEN b.open >= sell_price THEN 2 WHEN b.low <= stop_loss THEN 3 WHEN b.high >= sell_price THEN 4 WHEN b.k >= {RSI.max_holding} THEN 5 END AS v, b.open AS o, b.close AS cl
    FROM st LEFT JOIN LATERAL (SELECT bar_date AS bd, open, high, low, close, row_number() OVER (ORDER BY bar_date) AS k FROM bars WHERE bars.ticker = st.ticker AND bars.bar_date > st.signal_date ORDER BY bar_date LIMIT {RSI.max_holding}) b ON true),
s5 AS (SELECT *, row_number() OVER (PARTITION BY ticker, signal_date ORDER BY v IS NULL, k) AS pick, CASE v WHEN 1 THEN o WHEN 2 THEN o WHEN 3 THEN stop_loss * (1 - {RSI.slippage}) WHEN 4 THEN sell_price WHEN 5 THEN cl END AS xp FROM s4),
se AS (SELECT ticker, signal_date, strategy, signal, tier, buy_price AS entry_price, coalesce(['LOSS', 'WIN', 'LOSS', 'WIN', 'EXPIRED'][v], 'OPEN') AS status, {O.rnd('xp', 2)} AS exit_price, ['gap_down_stop', 'gap_up_target', 'stop_hit_intraday', 'target_hit', 'expired'][v] AS exit_reason, CASE WHEN v IS NOT NULL THEN k::INT END AS holding_days, {O.rnd(f'(xp - buy_price) / buy_price * 100 - {RSI.commission}', 2)} AS pnl_pct, CASE WHEN v IS NOT NULL THEN bd END AS exit_date FROM s5 WHERE pick = 1)"""


@register("q_j10_settle_signals", f"{SETTLED} SELECT ticker, signal_date, strategy, entry_price, status, exit_price, exit_reason, holding_days, pnl_pct, exit_date FROM se")
def q_j10(spark, sf):
    return trades.settle_signals(stored_signals(spark, sf), weekly(spark, sf))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    s = stored_signals(spark, sf)
    return trades.settle_signals(s, weekly(spark, sf)).where("status <> 'OPEN'").join(s.select("ticker", "signal_date", "strategy", "tier", (F.col("signal") == "Strong Buy").alias("confirmed_filled")), tables.KEY)


@register("q_g10_outcome_report", f"{SETTLED}, oc AS (SELECT *, unnest(list_filter(['all', tier, CASE WHEN signal = 'Strong Buy' THEN 'confirmed' END], lambda x: x IS NOT NULL)) AS report FROM se WHERE status <> 'OPEN') {O.summary('oc', 'report')}")
def q_g10(spark, sf):
    return rounded(metrics.outcome_report(outcomes(spark, sf)))


@register("q_g11_signal_counts", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)}, {O.EARNINGS} SELECT strategy, signal, count(*)::BIGINT AS n, count(*) FILTER (WHERE coalesce((SELECT min(e.earnings_ts) FROM earnings e WHERE e.ticker = sc.ticker AND e.earnings_ts >= sc.as_of::TIMESTAMP) <= sc.as_of::TIMESTAMP + INTERVAL {RSI.earnings_warning_days} DAY, false))::BIGINT AS catalyst_warnings FROM sc GROUP BY ALL")
def q_g11(spark, sf):
    rows = levels.levels(joins.next_earnings(frame(spark, sf, RSI), earnings(spark, sf)), RSI, keep=("next_earnings_ts",))
    return metrics.signal_counts(scoring.scored(rows, RSI).withColumn("catalyst_warning", joins.catalyst_warning(RSI.earnings_warning_days, "as_of")))


@register("q_g12_settlement_counts", f"{SETTLED}, nb AS (SELECT ticker, max(bar_date) AS newest FROM bars GROUP BY 1) SELECT CASE WHEN newest <= signal_date THEN 'PENDING_NO_DATA' WHEN ticker < 'C' THEN 'ERROR' ELSE status END AS outcome, count(*)::BIGINT AS n FROM se JOIN nb USING (ticker) GROUP BY 1")
def q_g12(spark, sf):
    s, b = stored_signals(spark, sf), weekly(spark, sf)
    return metrics.settlement_counts(trades.settle_signals(s, b).where("ticker >= 'C'"), s, b)  # the others went wrong


@register("q_g14_progress", f"{SETTLED} SELECT count(*)::BIGINT AS n, round(count(*) FILTER (WHERE status = 'WIN') * 100.0 / count(*), 6) AS win_rate_pct, date_diff('day', min(exit_date), DATE '{END}')::INT AS days_running FROM se WHERE status <> 'OPEN'")
def q_g14(spark, sf):
    return rounded(metrics.progress(outcomes(spark, sf), "rsi", END))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """An old table of signals up to a day, met by a scan of all days with another tier."""
    s = stored_signals(spark, sf).drop("config", "settled")
    old = s.where(F.col("signal_date") <= F.lit(DAY).cast("date")).withColumn("confirmed_filled", F.lit(True)).withColumn("fill_price", F.col("buy_price")).withColumn("settled", F.lit(True)).withColumn("created_at", F.lit("2020-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    new = s.drop("confirmed_filled", "fill_price").withColumn("tier", F.lit("research_loosened")).withColumn("settled", F.lit(False)).where(F.year("signal_date") >= 1996)
    return tables.upsert(old, new, now="2021-01-01")


@register("q_k01_upsert_signals", f"{STORED} SELECT ticker, signal_date, strategy, CASE WHEN year(signal_date) >= 1996 THEN 'research_loosened' ELSE tier END AS tier, year(signal_date) < 1996 AS settled, signal_date <= DATE '{DAY}' AS was_there, CASE WHEN signal_date <= DATE '{DAY}' THEN true END AS confirmed_filled, CASE WHEN signal_date <= DATE '{DAY}' THEN buy_price END AS fill_price, CASE WHEN signal_date <= DATE '{DAY}' THEN 2020 ELSE 2021 END::INT AS created_year, CASE WHEN year(signal_date) >= 1996 THEN 2021 ELSE 2020 END::INT AS updated_year FROM st WHERE signal_date <= DATE '{DAY}' OR year(signal_date) >= 1996")
def q_k01(spark, sf):
    return upserted(spark, sf).select("ticker", "signal_date", "strategy", "tier", "settled", (F.year("created_at") == 2020).alias("was_there"), "confirmed_filled", "fill_price", F.year("created_at").alias("created_year"), F.year("updated_at").alias("updated_year"))


@register("q_k11_month_upsert", f"{STORED}, m AS (SELECT *, strftime(signal_date, '%Y-%m') AS month, strftime(signal_date, '%Y-%m') IN ('1996-06', '1997-02') AS again FROM st) SELECT ticker, signal_date, strftime(signal_date, '%Y-%m') AS month, CASE WHEN again THEN 'research_loosened' ELSE tier END AS tier, 2020::INT AS created_year, CASE WHEN again THEN 2021 ELSE 2020 END::INT AS updated_year, CASE WHEN again THEN 2 ELSE 1 END AS writes FROM m")
def q_k11(spark, sf):
    """All signals, then those of two months again: only these two months are written a second time."""
    path = scratch(spark)
    s = kept(stored_signals(spark, sf).drop("config", "settled").withColumn("confirmed_at", F.lit(None).cast("timestamp")))
    versions.upsert_months(s, path, "2020-01-01")
    first = versions.manifest(spark, path)[1]["partitions"]
    versions.upsert_months(s.where(versions.month().isin("1996-06", "1997-02")).withColumn("tier", F.lit("research_loosened")), path, "2021-01-01")
    twice = [p for p, folder in versions.manifest(spark, path)[1]["partitions"].items() if first.get(p) != folder]
    out = versions.read_table(spark, path).withColumn("month", versions.month())
    return out.select("ticker", "signal_date", "month", "tier", F.year("created_at").alias("created_year"), F.year("updated_at").alias("updated_year"), F.when(F.col("month").isin(twice), 2).otherwise(1).alias("writes"))


@register("q_k02_tier_counts", f"{STORED} SELECT tier, count(*)::BIGINT AS n FROM st GROUP BY 1")
def q_k02(spark, sf):
    return tables.tier_counts(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI))


@register("q_k04_mark_settled", f"{SETTLED} SELECT status <> 'OPEN' AS settled, count(*)::BIGINT AS n FROM se GROUP BY 1")
def q_k04(spark, sf):
    s = stored_signals(spark, sf)
    done = trades.settle_signals(s, weekly(spark, sf)).where("status <> 'OPEN'")
    return tables.mark_settled(s, done).groupBy("settled").agg(F.count("*").alias("n"))


@register("q_k05_confirm", f"{STORED} SELECT ticker, signal_date, strategy, signal = 'Strong Buy' AS confirmed_filled, CASE WHEN signal = 'Strong Buy' THEN stop_loss END AS fill_price FROM st WHERE signal IN ('Strong Buy', 'Buy')")
def q_k05(spark, sf):
    s = stored_signals(spark, sf).where("tier = 'actionable'").withColumn("confirmed_at", F.lit(None).cast("timestamp"))
    event = lambda yes, at, rows: rows.select(*tables.KEY, F.lit(yes).alias("confirmed"), F.col("stop_loss").alias("fill_price"), F.lit(at).cast("timestamp").alias("at"))
    # A later confirmation without a price keeps the price given before; an undone one clears it.
    again = event(True, "2021-01-03", s.where("signal = 'Strong Buy'")).withColumn("fill_price", F.lit(None).cast("double"))
    events = event(True, "2021-01-01", s).union(event(False, "2021-01-02", s.where("signal <> 'Strong Buy'"))).union(again)
    return tables.confirm(s, events).select(*tables.KEY, "confirmed_filled", "fill_price")


@register("q_r04_pending", f"{STORED} SELECT ticker, signal_date, strategy FROM st WHERE tier = 'actionable' AND signal_date > DATE '{DAY}'")
def q_r04(spark, sf):
    s = stored_signals(spark, sf).withColumn("confirmed_filled", F.col("signal_date") <= F.lit(DAY).cast("date"))
    return tables.pending_confirmation(s).select("ticker", "signal_date", "strategy")


# Ranking, sizing, allocation


@register("q_r01_ranked", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)} SELECT ticker, as_of, trade_score FROM sc WHERE signal <> 'Ignore'")
def q_r01(spark, sf):
    return scoring.ranked(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI).where("signal <> 'Ignore'").select("ticker", "as_of", "trade_score"))


MERGED = " UNION ALL ".join(f"(SELECT * FROM ({O.base(CFG[s])}, {O.levels(CFG[s])}, {O.scores(CFG[s])} SELECT ticker, strategy, max(trade_score) AS s FROM sc GROUP BY ALL))" for s in ("rsi", "pullback", "week52"))


@register("q_r02_top_candidates", f"SELECT ticker, max(s) AS best, count(*)::INT AS n FROM ({MERGED}) GROUP BY 1 ORDER BY best DESC, ticker LIMIT 10")
def q_r02(spark, sf):
    some = [CFG[s] for s in ("rsi", "pullback", "week52")]
    out = scoring.scored(levels.dispatch(frame(spark, sf), some), *some).groupBy("ticker", "strategy").agg(F.max("trade_score").alias("trade_score"))
    return joins.merge_candidates(out).select("ticker", "best", F.size("scores").alias("n")).limit(10)


SHARES = f"CASE WHEN buy_price - stop_loss > 0 THEN {O.rnd('100.0 / (buy_price - stop_loss)', 4)} ELSE 0.0 END"


@register("q_a01_sizing", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)} SELECT ticker, as_of, {SHARES} AS shares, {O.rnd(f'({SHARES}) * buy_price', 2)} AS est_cost FROM sc WHERE signal IN ('Strong Buy', 'Buy')")
def q_a01(spark, sf):
    rows = scoring.actionable(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI))
    return allocation.sized(rows, risk=100.0).select("ticker", "as_of", "shares", "est_cost")


ALLOCATION = f"""WITH RECURSIVE q AS ({O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)}, {HOLD}, z AS (SELECT *, {SHARES} AS shares FROM sc WHERE signal IN ('Strong Buy', 'Buy', 'Watch'))
    SELECT as_of, ticker, sector, signal, {O.rnd('shares * buy_price', 2)} AS cost, row_number() OVER (PARTITION BY as_of ORDER BY trade_score DESC, ticker) AS k, (SELECT sum(amount) FROM h) AS held, coalesce((SELECT sum(amount) FROM h WHERE h.sector = z.sector), 0.0) AS seed FROM z),
r AS (SELECT as_of, 0::BIGINT AS k, NULL::VARCHAR AS ticker, NULL::VARCHAR AS final_signal, 0.0::DOUBLE AS spent, 900.0::DOUBLE AS rest, MAP([]::VARCHAR[], []::DOUBLE[]) AS by_sector FROM (SELECT DISTINCT as_of FROM q)
    UNION ALL SELECT q.as_of, q.k, q.ticker, CASE WHEN q.signal NOT IN ('Strong Buy', 'Buy') THEN q.signal WHEN q.cost > r.rest THEN 'Insufficient Funds' WHEN q.seed + coalesce(r.by_sector[q.sector], 0) + q.cost > 0.3 * (900 + q.held) THEN 'Sector Limit Reached' ELSE q.signal END,
    CASE WHEN q.signal IN ('Strong Buy', 'Buy') AND q.cost <= r.rest AND q.seed + coalesce(r.by_sector[q.sector], 0) + q.cost <= 0.3 * (900 + q.held) THEN q.cost ELSE 0.0 END,
    r.rest - CASE WHEN q.signal IN ('Strong Buy', 'Buy') AND q.cost <= r.rest AND q.seed + coalesce(r.by_sector[q.sector], 0) + q.cost <= 0.3 * (900 + q.held) THEN q.cost ELSE 0.0 END,
    CASE WHEN q.signal IN ('Strong Buy', 'Buy') AND q.cost <= r.rest AND q.seed + coalesce(r.by_sector[q.sector], 0) + q.cost <= 0.3 * (900 + q.held) THEN map_concat(r.by_sector, MAP([q.sector], [coalesce(r.by_sector[q.sector], 0) + q.cost])) ELSE r.by_sector END
    FROM r JOIN q ON q.as_of = r.as_of AND q.k = r.k + 1)
SELECT as_of, ticker, final_signal, round(spent, 2) AS spent, round(sum(spent) OVER (PARTITION BY as_of), 2) AS allocated FROM r WHERE k > 0"""


@register("q_a02_allocation", ALLOCATION)
def q_a02(spark, sf):
    rows = allocation.sized(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI).where("signal <> 'Ignore'"), risk=100.0)
    done = allocation.allocate(rows, ["as_of"], 900.0, cap_share=0.3, holdings=holdings(spark, sf))
    return done.select("as_of", "ticker", "final_signal", F.round("spent", 2).alias("spent"), F.round("allocated", 2).alias("allocated"))


@register("q_j13_sector_breakdown", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)}, {HOLD}, sp AS (SELECT sector, sum({O.rnd(f'({SHARES}) * buy_price', 2)}) AS s FROM sc WHERE signal IN ('Strong Buy', 'Buy') GROUP BY 1), hs AS (SELECT sector, sum(amount) AS a FROM h GROUP BY 1) SELECT coalesce(sp.sector, hs.sector) AS sector, round(coalesce(a, 0), 2) AS held, round(coalesce(s, 0), 2) AS new_spend, round(coalesce(a, 0) + coalesce(s, 0), 2) AS total FROM sp FULL JOIN hs ON sp.sector = hs.sector")
def q_j13(spark, sf):
    spend = allocation.sized(scoring.actionable(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI)), risk=100.0)
    return rounded(joins.sector_breakdown(holdings(spark, sf), spend), 2)


@register("q_d01_supplier_breakouts", f"WITH bars AS (SELECT l_suppkey::VARCHAR AS ticker, l_shipdate::DATE AS bar_date, {O.AGGREGATES} FROM lineitem GROUP BY ALL), x AS (SELECT *, max(high) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hh, avg(close) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS ma, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) AS rn FROM bars) SELECT ticker, bar_date, close FROM x WHERE rn >= 40 AND close > hh AND close >= ma")
def q_d01(spark, sf):
    df = B.daily_supplier_bars(spark, sf).withColumn("bar_date", F.to_date("bar_date"))
    df = df.withColumn("hh", indicators.prior_high(20)).withColumn("ma", indicators.sma("close", 40))
    return df.where("close > hh AND close >= ma").select("ticker", "bar_date", "close")


# Readers of texts, on inputs made of the given tables


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return B.universe(spark, sf)


def watchlist_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: one text for each region: JSON entries, a JSON array of names, plain lines, or JSON that is cut off."""
    rows = nations(spark, sf).groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("nation_key", "ticker"))).alias("r"))
    name = lambda x: F.concat(F.lit(" "), F.lower(x["ticker"]))
    entries = F.transform("r", lambda x: F.struct(name(x).alias("ticker"), F.col("sector").alias("sector")))
    plain = F.array_join(F.transform("r", name), "\n \n")
    kind = F.length("sector") % 4
    text = F.when(kind == 0, F.to_json(F.struct(entries.alias("watchlist")))).when(kind == 1, F.to_json(F.transform("r", name))).when(kind == 2, plain).otherwise(F.concat(F.lit("[\n"), plain))
    return rows.select("sector", text.alias("value")).withColumnRenamed("sector", "region")


@register("q_s05_watchlist", "SELECT r_name AS region, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 + CASE WHEN length(r_name) % 4 = 3 THEN 1 ELSE 0 END)::INT AS pos, n_name AS ticker, CASE WHEN length(r_name) % 4 = 0 THEN r_name END AS sector FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 0, '[', NULL FROM region WHERE length(r_name) % 4 = 3 AND r_regionkey IN (SELECT n_regionkey FROM nation)")
def q_s05(spark, sf):
    return readers.watchlist(watchlist_texts(spark, sf)).select("region", "pos", "ticker", "sector")


@register("q_s06_sector_map", "SELECT n_name AS ticker, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '-X' ELSE r_name END AS sector FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 OR n_nationkey % 2 = 0")
def q_s06(spark, sf):
    first = nations(spark, sf).select(F.col("nation_key").alias("pos"), "ticker", F.when(F.col("nation_key") % 5 != 0, F.col("sector")).alias("sector"))
    later = nations(spark, sf).where("nation_key % 2 = 0").select((F.col("nation_key") + 100).alias("pos"), "ticker", F.concat(F.lit(" "), "sector", F.lit("-X ")).alias("sector"))
    blank = nations(spark, sf).select((F.col("nation_key") + 200).alias("pos"), "ticker", F.lit("").alias("sector"))
    return readers.sector_map(first.union(later).union(blank))


@register("q_s07_ticker_list", "WITH t AS (SELECT upper(string_agg(n_name || ' x' || n_regionkey, ', ' ORDER BY n_nationkey)) AS s FROM nation), w AS (SELECT unnest(regexp_split_to_array(s, '[\\s,]+')) AS ticker, unnest(range(0, len(regexp_split_to_array(s, '[\\s,]+'))))::INT AS pos FROM t) SELECT ticker, min(pos) AS pos FROM w WHERE ticker <> '' GROUP BY 1")
def q_s07(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("r"))
    return readers.ticker_list(rows.select(F.array_join(F.transform("r", lambda x: F.concat(F.lower(x["n_name"]), F.lit(" x"), x["n_regionkey"].cast("string"))), ", ").alias("value")))


@register("q_s08_holdings_text", "WITH l AS (SELECT s_nationkey, s_suppkey % 7 AS k, s_suppkey, round(s_acctbal::DOUBLE, 2) AS amount, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::DOUBLE END AS avg_cost FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 5 <> 0) SELECT 'N' || s_nationkey || '_' || k AS ticker, arg_max(amount, s_suppkey) AS amount, arg_max(coalesce(avg_cost, -1), s_suppkey) AS avg_cost FROM l GROUP BY ALL")
def q_s08(spark, sf):
    cost = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).when(F.col("s_suppkey") % 3 == 1, "none").otherwise("")
    amount = F.when(F.col("s_suppkey") % 5 == 0, "much").otherwise(F.round(F.col("s_acctbal").cast("double"), 2).cast("string"))
    line = F.concat(F.lit(" n"), F.col("s_nationkey").cast("string"), F.lit("_"), (F.col("s_suppkey") % 7).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(", "), amount, F.lit(","), cost)
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_nationkey", "s_suppkey", line.alias("line")).groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))).alias("r"))
    texts = rows.select(F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("value"))
    return readers.holdings_text(texts).select("ticker", "amount", F.coalesce("avg_cost", F.lit(-1.0)).alias("avg_cost"))


@register("q_s10_newest_earnings", f"WITH {O.BARS}, {O.EARNINGS} SELECT ticker, earnings_ts::DATE AS day FROM earnings QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY earnings_ts DESC) <= 4")
def q_s10(spark, sf):
    return readers.earnings_calendar(earnings(spark, sf), 4).select("ticker", F.to_date("earnings_ts").alias("day"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: a nation's suppliers are its news items; some have a title inside `content`, some one beside it, some none."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")
    df = s.join(nations(spark, sf), F.col("s_nationkey") == F.col("nation_key"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("s_suppkey"))
    inner = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("C "), "s_name")).otherwise("")
    return df.select("ticker", rank.alias("rank"), F.struct(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("title"), F.struct(inner.alias("title")).alias("content")).alias("item"))


NEWS = "nw AS (SELECT n_name AS ticker, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey)::INT AS rank, CASE WHEN s_suppkey % 4 = 0 THEN 'C ' || s_name WHEN s_suppkey % 3 <> 0 THEN s_name END AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@register("q_s11_headlines", f"WITH {NEWS} SELECT * FROM nw WHERE rank <= 3 AND title IS NOT NULL")
def q_s11(spark, sf):
    return readers.headlines(news(spark, sf))


@register("q_s12_top_headline", f"WITH {NEWS} SELECT ticker, coalesce(arg_min(title, rank) FILTER (WHERE rank <= 3 AND title IS NOT NULL), '') AS top_headline FROM nw GROUP BY 1")
def q_s12(spark, sf):
    return readers.top_headline(news(spark, sf))


@register("q_s04_bars_after", f"{STORED} SELECT st.ticker, signal_date, b.k::INT AS k, b.bar_date, b.close FROM st JOIN LATERAL (SELECT bar_date, close, row_number() OVER (ORDER BY bar_date) AS k FROM bars WHERE bars.ticker = st.ticker AND bars.bar_date > st.signal_date ORDER BY bar_date LIMIT 3) b ON true")
def q_s04(spark, sf):
    df = joins.bars_after(stored_signals(spark, sf).select("ticker", "signal_date"), weekly(spark, sf), 3)
    return df.where("bar IS NOT NULL").select("ticker", "signal_date", "k", "bar.bar_date", "bar.close")


@register("q_s15_unsettled", f"{STORED} SELECT ticker, signal_date, 'rsi' AS strategy, CASE WHEN signal = 'Watch' THEN 'actionable' ELSE tier END AS tier FROM st WHERE signal_date > DATE '{DAY}'")
def q_s15(spark, sf):
    old = stored_signals(spark, sf).withColumns({"settled": F.when(F.col("signal_date") <= F.lit(DAY).cast("date"), True), "strategy": F.lit(None).cast("string"), "tier": F.when(F.col("signal") != "Watch", F.col("tier"))})
    return tables.unsettled(old).select("ticker", "signal_date", "strategy", "tier")


# Sinks


@register("q_k03_upsert_outcomes", f"{SETTLED} SELECT ticker, signal_date, status, round(pnl_pct, 2) AS pnl_pct, CASE WHEN year(signal_date) >= 1996 THEN 2021 ELSE 2020 END::INT AS settled_year FROM se WHERE status <> 'OPEN' AND (signal_date <= DATE '{DAY}' OR year(signal_date) >= 1996)")
def q_k03(spark, sf):
    done = kept(trades.settle_signals(stored_signals(spark, sf), weekly(spark, sf)))
    old = done.where((F.col("signal_date") <= F.lit(DAY).cast("date")) & (F.col("status") != "OPEN")).withColumn("pnl_pct", F.when(F.year("signal_date") >= 1996, F.lit(-99.0)).otherwise(F.col("pnl_pct"))).withColumn("settled_at", F.lit("2020-01-01").cast("timestamp"))
    out = tables.upsert_outcomes(old, done.where(F.year("signal_date") >= 1996), "2021-01-01")
    return out.select("ticker", "signal_date", "status", F.round("pnl_pct", 2).alias("pnl_pct"), F.year("settled_at").alias("settled_year"))


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: a configuration for each region; the second one is active."""
    r = spark.read.parquet(f"{sf}/region.parquet")
    none = F.lit(None)
    return r.select((F.col("r_regionkey") + 1).cast("int").alias("version"), F.when(F.col("r_regionkey") == 1, "active").otherwise("candidate").alias("status"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("params"), none.cast("map<string,double>").alias("metrics"), none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("promoted_at"), F.col("r_name").alias("notes"))


CONFIGS = "c AS (SELECT (r_regionkey + 1)::INT AS version, CASE WHEN r_regionkey = 1 THEN 'active' ELSE 'candidate' END AS status, r_name AS notes FROM region)"


@register("q_k06_add_candidate", f"WITH {CONFIGS} SELECT version, status, notes, NULL::DOUBLE AS sharpe FROM c UNION ALL SELECT max(version) + 1, 'candidate', 'new', 1.5 FROM c")
def q_k06(spark, sf):
    return tables.add_candidate(configs(spark, sf), "{}", {"sharpe": 1.5}, "new", "2021-01-01").select("version", "status", "notes", F.col("metrics")["sharpe"].alias("sharpe"))


@register("q_k07_promote", f"WITH {CONFIGS} SELECT version, CASE WHEN version = 4 THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status, CASE WHEN version = 4 THEN 2021 END::INT AS promoted_year FROM c")
def q_k07(spark, sf):
    return tables.promote(configs(spark, sf), 4, "2021-01-01").select("version", "status", F.year("promoted_at").alias("promoted_year"))


@register("q_r05_active_config", f"WITH {CONFIGS} SELECT version, status, row_number() OVER (ORDER BY version DESC)::INT AS place, status = 'active' AS is_active FROM c")
def q_r05(spark, sf):
    df = tables.configs_newest_first(configs(spark, sf)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("version"))))
    active = tables.active_config(configs(spark, sf)).select("version", F.lit(True).alias("__a"))
    return df.join(active, "version", "left").select("version", "status", "place", F.coalesce("__a", F.lit(False)).alias("is_active"))


@register("q_k08_replace_holdings", "SELECT upper(trim(s_name)) AS ticker, s_acctbal::DOUBLE AS amount, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey > 0 THEN s_suppkey::DOUBLE ELSE -1 END AS avg_cost FROM supplier WHERE s_acctbal > 0")
def q_k08(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    rows = s.select(F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")).alias("ticker"), F.col("s_acctbal").cast("double").alias("amount"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(0).cast("double").alias("avg_cost"))
    path = scratch(spark)
    # What was held before is replaced as a whole.
    versions.replace_all(tables.clean_holdings(rows.withColumn("amount", F.lit(1.0)), "2020-01-01"), path)
    versions.replace_all(tables.clean_holdings(rows, "2021-01-01"), path)
    return versions.read_table(spark, path).select("ticker", "amount", F.coalesce("avg_cost", F.lit(-1.0)).alias("avg_cost"))


@register("q_k09_csv_export", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)} SELECT ticker, as_of, trade_score, signal FROM sc WHERE signal IN ('Strong Buy', 'Buy')")
def q_k09(spark, sf):
    rows = scoring.actionable(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI)).select("ticker", "as_of", "trade_score", "signal")
    path = scratch(spark)
    tables.export_csv(rows, path)
    return spark.read.csv(path, header=True, schema="ticker STRING, as_of DATE, trade_score DOUBLE, signal STRING")


@register("q_k10_signal_rows", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)} SELECT ticker, strftime(as_of, '%Y-%m-%d') AS signal_date, CASE WHEN rsi <= 40 THEN rsi END AS rsi, trade_score, false AS settled, '{{}}' AS config_snapshot FROM sc WHERE signal <> 'Ignore'")
def q_k10(spark, sf):
    rows = scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI).where("signal <> 'Ignore'")
    rows = rows.withColumn("rsi", F.when(F.col("rsi") > 40, F.lit(float("nan"))).otherwise(F.col("rsi")))
    return tables.signal_rows(rows, "{}", "2021-01-01").select("ticker", "signal_date", "rsi", "trade_score", "settled", "config_snapshot")


# The latest market gate, sectors, settlement after a confirmation, sizing by budget, search grids


@register("q_p01_market_gate_latest", f"{F1} SELECT bar_date, market_up FROM mk ORDER BY bar_date DESC LIMIT 1")
def q_p01(spark, sf):
    return joins.market_is_up(market(spark, sf), SMALL.sma_trend)


@register("q_j05_sector_lookup", f"WITH {O.BARS} SELECT bars.ticker, bar_date, CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown' ELSE u.sector END AS sector FROM bars JOIN u ON bars.ticker = u.ticker")
def q_j05(spark, sf):
    return joins.with_sector(weekly(spark, sf), nations(spark, sf).where("nation_key % 3 <> 0")).select("ticker", "bar_date", "sector")


CONFIRMED = SETTLED.replace("(xp - buy_price) / buy_price", "(xp - entry) / entry").replace("buy_price AS entry_price", "entry AS entry_price").replace("s5 AS (SELECT *,", "s5 AS (SELECT *, buy_price * 1.01::DOUBLE AS entry,").replace("FROM st LEFT JOIN LATERAL", f"FROM (SELECT * FROM st WHERE signal = 'Strong Buy' AND signal_date <= DATE '{DAY}') st LEFT JOIN LATERAL")


@register("q_j11_resettle", f"{CONFIRMED} SELECT ticker, signal_date, round(entry_price, 6) AS entry_price, status, pnl_pct FROM se")
def q_j11(spark, sf):
    s = stored_signals(spark, sf).withColumns({"settled": F.col("signal_date") <= F.lit(DAY).cast("date"), "fill_price": F.when(F.col("signal") == "Strong Buy", F.col("buy_price") * 1.01)})
    changed = s.where("fill_price IS NOT NULL").select(*tables.KEY)
    return trades.resettle(s, changed, weekly(spark, sf)).select("ticker", "signal_date", F.round("entry_price", 6).alias("entry_price"), "status", "pnl_pct")


FLAT = O.rnd("250.0 / nullif(buy_price, 0)", 4)


@register("q_a01_flat_budget", f"{O.base(RSI)}, {O.levels(RSI)}, {O.scores(RSI)} SELECT ticker, as_of, {FLAT} AS shares, {O.rnd(f'({FLAT}) * buy_price', 2)} AS est_cost FROM sc WHERE signal IN ('Strong Buy', 'Buy')")
def q_a01_flat(spark, sf):
    rows = scoring.actionable(scoring.scored(levels.levels(frame(spark, sf, RSI), RSI), RSI))
    return allocation.sized(rows, budget=250.0).select("ticker", "as_of", "shares", "est_cost")


SEARCH = selection.search_grid(PULL, 3, ("tp_mult", "sl_mult"))


@register("q_t13_search_grid", " UNION ALL ".join(f"(SELECT {i} AS config_id, count(*)::BIGINT AS n, round(sum(pnl_pct), 4) AS total FROM ({O.trades(c)} SELECT * FROM tr) HAVING count(*) > 0)" for i, c in SEARCH.items()))
def q_t13(spark, sf):
    df = selection.sweep(weekly(spark, sf), market(spark, sf), SEARCH)
    return df.groupBy("config_id").agg(F.count("*").alias("n"), F.round(F.sum("pnl_pct"), 4).alias("total"))


# Model verdicts


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Test input: a response for each nation; some decisions, confidences, reasons and bodies are not valid."""
    k = F.col("nation_key")
    decision = F.element_at(F.array(*map(F.lit, ("Buy", "Hold", "Avoid", "Sell"))), (k % 4 + 1).cast("int"))
    confidence = F.when(k % 5 == 0, F.lit("high")).otherwise((k * 6).cast("string"))
    body = F.to_json(F.struct(decision.alias("decision"), confidence.alias("confidence"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" as of "), "ticker")).alias("rationale")))
    return nations(spark, sf).select("ticker", F.when(k % 9 == 0, F.concat(F.lit("no "), body)).otherwise(body).alias("body"))


VERDICTS = "v AS (SELECT ticker, CASE n_nationkey % 4 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Hold' ELSE 'Avoid' END AS decision, (n_nationkey * 6)::DOUBLE AS confidence, 'as of ' || ticker AS rationale FROM u WHERE n_nationkey % 4 < 3 AND n_nationkey % 5 <> 0 AND n_nationkey * 6 <= 100 AND n_nationkey % 7 <> 0 AND n_nationkey % 9 <> 0)"


@register("q_p19_verdicts", f"WITH {O.BARS}, {VERDICTS} SELECT * FROM v")
def q_p19(spark, sf):
    return verdicts.parsed_verdicts(responses(spark, sf))


LAST = "la AS (SELECT * FROM f WHERE atr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) = 1)"


@register("q_p20_verdict_levels", f"{F1}, {VERDICTS}, {LAST}, b AS (SELECT v.ticker, bar_date AS as_of, CASE decision WHEN 'Buy' THEN 'Buy' ELSE 'Watch' END AS signal, confidence AS trade_score, {O.rnd('close', 2)} AS buy_price, atr FROM v JOIN la ON la.ticker = v.ticker WHERE decision <> 'Avoid'), x AS (SELECT *, {O.rnd(f'buy_price + atr * {SMALL.tp_mult}', 2)} AS sell_price, {O.rnd(f'buy_price - atr * {SMALL.sl_mult}', 2)} AS stop_loss FROM b) SELECT ticker, as_of, 'llm_agent' AS strategy, signal, trade_score, {O.rnd('atr', 2)} AS atr, buy_price, sell_price, stop_loss, CASE WHEN buy_price > stop_loss THEN {O.rnd('(sell_price - buy_price) / (buy_price - stop_loss)', 2)} ELSE 0.0 END AS rrr FROM x")
def q_p20(spark, sf):
    return verdicts.verdict_levels(verdicts.parsed_verdicts(responses(spark, sf)), indicators.latest(frame(spark, sf)), SMALL)


PROMPTED = ("rsi", "pullback", "week52")
PROMPT_SCORES = " UNION ALL ".join(f"(SELECT * FROM ({O.base(CFG[s])}, {O.levels(CFG[s])}, {O.scores(CFG[s])} SELECT ticker, as_of, strategy, trade_score, last_close, rsi, atr FROM sc))" for s in PROMPTED)
PROMPT_SQL = f"""WITH {O.BARS}, {O.EARNINGS}, {NEWS}, s AS MATERIALIZED ({PROMPT_SCORES}), z AS (SELECT * FROM s QUALIFY as_of = max(as_of) OVER (PARTITION BY ticker)),
    g AS (SELECT ticker, as_of, any_value(last_close) AS last_close, any_value(rsi) AS rsi, any_value(atr) AS atr, string_agg(strategy || '=' || printf('%.1f', trade_score), ', ' ORDER BY strategy) AS scores FROM z GROUP BY ALL),
    e AS (SELECT g.ticker, min(earnings_ts) AS next FROM g JOIN earnings USING (ticker) WHERE earnings_ts >= as_of::TIMESTAMP GROUP BY 1),
    fu AS (SELECT n_name AS ticker, 'largest=' || max(s_suppkey) || ', suppliers=' || count(*) AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    t AS (SELECT ticker, count(*) AS k, string_agg('- ' || title, chr(10) ORDER BY rank) AS t FROM nw WHERE rank <= 5 AND title IS NOT NULL GROUP BY 1)
SELECT g.ticker, 'Ticker ' || g.ticker || ': last close ' || printf('%.2f', last_close) || ', RSI ' || coalesce(printf('%.2f', rsi), 'unknown') || ', ATR ' || coalesce(printf('%.2f', atr), 'unknown') || '. Scores by strategy: ' || scores || '. Report within the warning window: ' || CASE WHEN coalesce(next <= as_of::TIMESTAMP + INTERVAL 14 DAY, false) THEN 'yes' ELSE 'no' END || '; next report: ' || coalesce(strftime(next, '%Y-%m-%d'), 'unknown') || '. Fundamentals: ' || coalesce(f, 'none') || '.' || chr(10) || 'Headlines (' || coalesce(k, 0) || '):' || chr(10) || coalesce(t, 'none') || chr(10) || '{verdicts.ANSWER}' AS prompt, coalesce(k, 0)::INT AS n_headlines
FROM g LEFT JOIN e ON e.ticker = g.ticker LEFT JOIN fu ON fu.ticker = g.ticker LEFT JOIN t ON t.ticker = g.ticker"""


@register("q_p21_prompts", PROMPT_SQL)
def q_p21(spark, sf):
    some = [CFG[s] for s in PROMPTED]
    rows = levels.dispatch(joins.next_earnings(frame(spark, sf), earnings(spark, sf)), some, keep=("next_earnings_ts",))
    rows = kept(scoring.scored(rows, *some).select("ticker", "as_of", "strategy", "trade_score", "last_close", "rsi", "atr", "next_earnings_ts", joins.catalyst_warning(14, "as_of").alias("catalyst_warning")))
    last = rows.join(rows.groupBy("ticker").agg(F.max("as_of").alias("as_of")), ["ticker", "as_of"])
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "trade_score")))).alias("scores")
    one = last.groupBy("ticker").agg(*(F.first(c).alias(c) for c in ("last_close", "rsi", "atr", "catalyst_warning")), F.to_date(F.first("next_earnings_ts")).alias("next_earnings_date"), scores)
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(nations(spark, sf), F.col("s_nationkey") == F.col("nation_key"))
    facts = s.groupBy("ticker").agg(F.create_map(F.lit("suppliers"), F.count("*").cast("string"), F.lit("largest"), F.max("s_suppkey").cast("string")).alias("fundamentals"))
    return verdicts.prompts(one.join(facts, "ticker", "left"), readers.headlines(news(spark, sf), 5))
