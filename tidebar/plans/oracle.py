"""DuckDB SQL for the registered queries, written on its own: common table expressions put together by name."""

from __future__ import annotations

from ..config import StrategyConfig

PRICE = "l_extendedprice::DOUBLE"
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
AGGREGATES = f"first({PRICE} ORDER BY {ORDER}) AS open, max({PRICE}) AS high, min({PRICE}) AS low, last({PRICE} ORDER BY {ORDER}) AS close, sum(l_quantity::DOUBLE) AS volume"

BARS = f"""u AS (SELECT n_nationkey, n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
bars AS (SELECT ticker, sector, date_trunc('week', l_shipdate)::DATE AS bar_date, {AGGREGATES} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN u ON s_nationkey = n_nationkey GROUP BY ALL),
mbars AS (SELECT date_trunc('week', l_shipdate)::DATE AS bar_date, {AGGREGATES} FROM lineitem GROUP BY 1)"""

EARNINGS = """er AS (SELECT ticker, bar_date, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) AS k FROM bars),
earnings AS (SELECT er.ticker, bar_date::TIMESTAMP AS earnings_ts FROM er JOIN u ON er.ticker = u.ticker WHERE (k + n_nationkey) % 13 = 0)"""


def rnd(x: str, k: int) -> str:
    return f"(round_even(({x}) * 1e{k}, 0) / 1e{k})"


def full(agg: str, x: str, n: int, frame: str = "") -> str:
    frame = frame or f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    w = f"OVER (PARTITION BY ticker ORDER BY bar_date {frame})"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg} {w} END"


def smooth(x: str, n: int, t: str) -> str:
    r, a = f"(1.0::DOUBLE - 1.0::DOUBLE / {n})", f"(1.0::DOUBLE / {n})"
    return f"CASE WHEN {x} IS NOT NULL AND {t} >= {n - 1} THEN pow({r}, {t}) * sum(CASE WHEN {t} = 0 THEN {x} ELSE {x} * {a} END * pow({r}, -{t})) OVER w END"


def frame(cfg: StrategyConfig) -> str:
    """Indicators of all bars, as CTE `f`."""
    c = cfg
    return f"""
a1 AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
a2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS dn,
    CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END END AS pdm,
    CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END END AS mdm,
    CASE WHEN pc IS NULL THEN 0.0 ELSE sign(close - pc) * volume END AS flow,
    {full('avg(close)', 'close', c.ma_window)} AS sma, {full('avg(close)', 'close', c.sma_trend)} AS sma_trend, {full('avg(volume)', 'volume', c.volume_lookback)} AS avg_volume,
    {full('max(high)', 'high', c.breakout_lookback, f'ROWS BETWEEN {c.breakout_lookback} PRECEDING AND 1 PRECEDING')} AS highest_high, {full('max(high)', 'high', c.week52_lookback)} AS week52_high,
    min(low) OVER (PARTITION BY ticker ORDER BY bar_date ROWS BETWEEN {c.support_lookback - 1} PRECEDING AND CURRENT ROW) AS support_level,
    {full('avg(close)', 'close', c.pullback_ma)} AS ma_pullback,
    {full('stddev_samp(close)', 'close', c.bb_window)} / nullif({full('avg(close)', 'close', c.bb_window)}, 0) AS volatility,
    close / nullif(lag(close, {c.breakout_lookback}) OVER (PARTITION BY ticker ORDER BY bar_date), 0) - 1 AS k_return FROM a1),
a3 AS (SELECT *, CASE WHEN up IS NOT NULL THEN count(up) OVER w - 1 END AS t, sum(flow) OVER w AS obv, lag(avg_volume) OVER w AS avg_volume_prior, lag(ma_pullback, {c.pullback_slope}) OVER w AS ma_pullback_prior, coalesce(close > highest_high, false) AS breakout_flag,
    {full('avg(volatility)', 'volatility', c.squeeze_window)} AS vm, {full('stddev_samp(volatility)', 'volatility', c.squeeze_window)} AS vs
    FROM a2 WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
a4 AS (SELECT *, {smooth('up', c.rsi_window, 't')} AS gain, {smooth('dn', c.rsi_window, 't')} AS loss, {smooth('tr', c.atr_window, 't')} AS atr,
    {smooth('tr', c.adx_window, 't')} AS tr2, {smooth('pdm', c.adx_window, 't')} AS pdm2, {smooth('mdm', c.adx_window, 't')} AS mdm2,
    lag((volatility - vm) / nullif(vs, 0)) OVER w AS squeeze_zscore, (obv - {full('avg(obv)', 'obv', c.obv_window)}) / nullif({full('stddev_samp(obv)', 'obv', c.obv_window)}, 0) AS obv_zscore,
    last_value(CASE WHEN breakout_flag THEN highest_high END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY bar_date) AS last_breakout_level,
    rn - last_value(CASE WHEN breakout_flag THEN rn END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY bar_date) AS days_since_breakout,
    volume / nullif(avg_volume_prior, 0) AS volume_ratio
    FROM a3 WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
a5 AS (SELECT *, 100.0 * gain / nullif(gain + loss, 0) AS rsi, 100.0 * abs(pdm2 / nullif(tr2, 0) - mdm2 / nullif(tr2, 0)) / nullif(pdm2 / nullif(tr2, 0) + mdm2 / nullif(tr2, 0), 0) AS dx FROM a4),
a6 AS (SELECT *, CASE WHEN dx IS NOT NULL THEN count(dx) OVER w - 1 END AS t2, coalesce(rsi < {c.rsi_oversold}, false) AS below FROM a5 WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
a7 AS (SELECT *, {smooth('dx', c.adx_window, 't2')} AS adx, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER w AS run FROM a6 WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
mk AS (SELECT bar_date, close / nullif(lag(close, {c.breakout_lookback}) OVER (ORDER BY bar_date), 0) - 1 AS market_return, coalesce(close >= CASE WHEN count(close) OVER (ORDER BY bar_date ROWS BETWEEN {c.sma_trend - 1} PRECEDING AND CURRENT ROW) = {c.sma_trend} THEN avg(close) OVER (ORDER BY bar_date ROWS BETWEEN {c.sma_trend - 1} PRECEDING AND CURRENT ROW) END, false) AS market_up FROM mbars),
f AS (SELECT a7.*, CASE WHEN below THEN sum(CASE WHEN below THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, run ORDER BY a7.bar_date) ELSE 0 END AS oversold_streak_days, k_return - mk.market_return AS relative_strength,
    (SELECT min(b2.bar_date) FROM bars b2 WHERE b2.ticker = a7.ticker AND b2.low = a7.support_level AND b2.bar_date <= a7.bar_date AND b2.bar_date >= (SELECT min(b3.bar_date) FROM a1 b3 WHERE b3.ticker = a7.ticker AND b3.rn > a7.rn - {c.support_lookback})) AS support_date
    FROM a7 LEFT JOIN mk ON a7.bar_date = mk.bar_date)"""


def gates(cfg: StrategyConfig) -> str:
    need = {
        "rsi": [("close", "no close"), ("sma", "short history: sma"), ("sma_trend", "short history: trend"), ("rsi", "short history: rsi"), ("atr", "short history: atr"), ("avg_volume", "short history: volume")],
        "breakout": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("highest_high", "short history: high")],
        "pullback": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("ma_pullback", "short history: pullback"), ("ma_pullback_prior", "short history: slope")],
        "retest": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume")],
        "week52": [("close", "no close"), ("sma_trend", "short history: trend"), ("atr", "short history: atr"), ("avg_volume", "short history: volume"), ("week52_high", "short history: high")],
    }[cfg.strategy]
    return "CASE " + " ".join(f"WHEN {c} IS NULL THEN '{r}'" for c, r in need) + f" WHEN close < sma_trend THEN 'downtrend' WHEN avg_volume * close < {cfg.min_dollar_volume} THEN 'illiquid' END"


ENTRY = {
    "rsi": ("support_level", "(close - buy_price) / buy_price * 100", "close <= buy_price AND rsi < {c.rsi_oversold}"),
    "breakout": ("highest_high", "(close - buy_price) / buy_price * 100", "close > highest_high"),
    "pullback": ("ma_pullback", "(close - buy_price) / buy_price * 100", "ma_pullback > ma_pullback_prior AND abs((close - buy_price) / buy_price * 100) <= {c.pullback_band}"),
    "retest": ("coalesce(last_breakout_level, close)", "CASE WHEN last_breakout_level IS NULL THEN 0.0 ELSE (close - buy_price) / buy_price * 100 END", "last_breakout_level IS NOT NULL AND days_since_breakout > 0 AND days_since_breakout <= {c.retest_window} AND abs((close - buy_price) / buy_price * 100) <= {c.retest_band}"),
    "week52": ("close", "(week52_high - close) / week52_high * 100", "(week52_high - close) / week52_high * 100 <= {c.week52_nearness}"),
}
OWN = {
    "rsi": "{sma} AS sma, {disc} AS ma_discount_price, {sup} AS support_level, support_date, oversold_streak_days::INT AS oversold_streak_days, (oversold_streak_days >= {c.decline_days}) AS extended_decline_warning",
    "breakout": "buy_price AS trigger_price, {rs} AS relative_strength, {vr} AS volume_ratio, {adx} AS adx, {oz} AS obv_zscore, {sz} AS squeeze_zscore",
    "pullback": "buy_price AS ma_pullback, {adx} AS adx",
    "retest": "days_since_breakout::INT AS days_since_breakout, {adx} AS adx",
    "week52": "{hi} AS week52_high",
}


def levels(cfg: StrategyConfig) -> str:
    """Levels of all bars as CTE `lv`, with the bar's number."""
    price, far, trigger = ENTRY[cfg.strategy]
    own = OWN[cfg.strategy].format(c=cfg, sma=rnd("sma", 2), disc=rnd(f"sma * (1 - {cfg.ma_discount})", 2), sup=rnd("support_level", 2), rs=rnd("relative_strength", 4) if cfg.strategy == "breakout" else "NULL", vr=rnd("volume_ratio", 3), adx=rnd("adx", 2), oz=rnd("obv_zscore", 3), sz=rnd("squeeze_zscore", 3), hi=rnd("week52_high", 2))
    return f"""
l1 AS (SELECT *, {rnd(price, 2)} AS buy_price, {gates(cfg)} AS exclude_reason FROM f),
l2 AS (SELECT *, {rnd(f'buy_price + atr * {cfg.tp_mult}', 2)} AS sell_price, {rnd(f'buy_price - atr * {cfg.sl_mult}', 2)} AS stop_loss, {far} AS far, coalesce({trigger.format(c=cfg)}, false) AS trigger FROM l1),
lv AS (SELECT ticker, sector, rn, bar_date AS as_of, '{cfg.strategy}' AS strategy, {rnd('close', 2)} AS last_close, {rnd('rsi', 2)} AS rsi, {rnd('atr', 2)} AS atr, buy_price, sell_price, stop_loss,
    CASE WHEN buy_price - stop_loss > 0 THEN {rnd('(sell_price - buy_price) / (buy_price - stop_loss)', 2)} ELSE 0.0 END AS rrr, {rnd('far', 2)} AS distance_to_buy_pct, trigger, exclude_reason, {own} FROM l2)"""


def scores(cfg: StrategyConfig) -> str:
    """Scored rows that pass the gates as CTE `sc`."""
    c = cfg
    clip = lambda x, lo, hi: f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE) END)"
    reward = f"{clip('rrr', 0, c.rrr_cap)} / {c.rrr_cap} * {c.rrr_weight}"
    near = f"(1 - {clip('distance_to_buy_pct', 0, c.distance_cap)} / {c.distance_cap}) * {c.distance_weight}"
    filters = f"(rsi IS NULL OR rsi < {c.breakout_rsi_max}) AND (relative_strength IS NULL OR relative_strength >= {c.breakout_relative_strength_min}) AND (volume_ratio IS NULL OR volume_ratio >= {c.breakout_volume_ratio_min}) AND (adx IS NULL OR adx >= {c.breakout_adx_min}) AND (obv_zscore IS NULL OR obv_zscore >= {c.breakout_obv_min}) AND (squeeze_zscore IS NULL OR squeeze_zscore <= {c.breakout_squeeze_max})" if c.strategy == "breakout" else "true"
    if c.strategy == "rsi":
        low = f"({c.rsi_ceiling} - {clip('rsi', c.rsi_floor, c.rsi_ceiling)}) / ({c.rsi_ceiling} - {c.rsi_floor}) * {c.rsi_weight}"
        penalty = f"least(greatest(oversold_streak_days - {c.decline_days}, 0) * {c.decline_penalty}, {c.decline_penalty_cap})"
        score = f"greatest({reward} + {low} + {near} - {penalty}, 0.0)"
        fires = "signal IN ('Strong Buy', 'Buy')"
    else:
        score = f"CASE WHEN trigger AND {filters} THEN greatest(({reward} + {near}) * (100 / {c.rrr_weight + c.distance_weight}), 0.0) ELSE 0.0 END"
        fires = f"trigger AND {filters}"
    return f"""
s1 AS (SELECT *, {rnd(score, 1)} AS trade_score FROM lv WHERE exclude_reason IS NULL),
s2 AS (SELECT *, CASE WHEN trade_score > {c.strong_buy_above} THEN 'Strong Buy' WHEN trade_score >= {c.buy_from} THEN 'Buy' WHEN trade_score >= {c.watch_from} THEN 'Watch' ELSE 'Ignore' END AS signal FROM s1),
sc AS (SELECT *, {fires} AS fires FROM s2)"""


def settled(cfg: StrategyConfig, source: str, out: str = "tr", earnings: bool = False) -> str:
    """Fills and exits of the candidate rows in `source` as CTE `out`."""
    c = cfg
    side = ("open >= buy_price", "high >= buy_price") if c.strategy == "breakout" else ("open <= buy_price", "low <= buy_price")
    extra = "trade_score, rsi, rrr, " if c.strategy == "rsi" else ""
    warn = f"coalesce((SELECT min(e.earnings_ts) FROM earnings e WHERE e.ticker = p.ticker AND e.earnings_ts >= p.as_of::TIMESTAMP) <= p.as_of::TIMESTAMP + INTERVAL {c.earnings_warning_days} DAY, false)" if earnings else "false"
    return f"""
{out}1 AS (SELECT p.ticker, p.sector, p.strategy, p.as_of, p.signal, p.atr, p.buy_price AS signal_buy_price, p.trade_score, p.rsi, p.rrr, p.rn, {warn} AS catalyst_warning,
    min(b.rn) FILTER (WHERE {side[0]} OR {side[1]}) AS entry_rn FROM {source} p JOIN a1 b ON b.ticker = p.ticker AND b.rn > p.rn AND b.rn <= p.rn + {c.max_entry_wait} GROUP BY ALL),
{out}2 AS (SELECT x.*, b.bar_date AS entry_date, CASE WHEN b.{side[0].replace('buy_price', 'x.signal_buy_price')} THEN b.open ELSE x.signal_buy_price END AS buy_price FROM {out}1 x JOIN a1 b ON b.ticker = x.ticker AND b.rn = x.entry_rn),
{out}3 AS (SELECT *, {rnd(f'buy_price - atr * {c.sl_mult}', 2)} AS stop_loss, {rnd(f'buy_price + atr * {c.tp_mult}', 2)} AS sell_price FROM {out}2),
{out}4 AS (SELECT x.*, b.rn - x.entry_rn AS k, b.bar_date AS bd, CASE WHEN b.open <= stop_loss THEN 1 WHEN b.open >= sell_price THEN 2 WHEN b.low <= stop_loss THEN 3 WHEN b.high >= sell_price THEN 4 WHEN b.rn - x.entry_rn >= {c.max_holding} THEN 5 END AS v, b.open AS o, b.close AS cl FROM {out}3 x LEFT JOIN a1 b ON b.ticker = x.ticker AND b.rn > x.entry_rn AND b.rn <= x.entry_rn + {c.max_holding}),
{out}5 AS (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY v IS NULL, k) AS pick, CASE v WHEN 1 THEN o WHEN 2 THEN o WHEN 3 THEN stop_loss * (1 - {c.slippage}) WHEN 4 THEN sell_price WHEN 5 THEN cl END AS xp FROM {out}4),
{out} AS (SELECT ticker, coalesce(sector, 'Unknown') AS sector, strategy, as_of AS signal_date, entry_date, signal, atr, buy_price, signal_buy_price, stop_loss, sell_price, catalyst_warning, {extra}
    coalesce(['LOSS', 'WIN', 'LOSS', 'WIN', 'EXPIRED'][v], 'OPEN') AS status, {rnd('xp', 2)} AS exit_price, ['gap_down_stop', 'gap_up_target', 'stop_hit_intraday', 'target_hit', 'expired'][v] AS exit_reason, CASE WHEN v IS NOT NULL THEN k::INT END AS holding_days,
    {rnd(f'(xp - buy_price) / buy_price * 100 - {c.commission}', 2)} AS pnl_pct, CASE WHEN v IS NOT NULL THEN bd END AS exit_date FROM {out}5 WHERE pick = 1)"""


def base(cfg: StrategyConfig) -> str:
    return f"WITH {BARS}, {frame(cfg)}"


def gated(cfg: StrategyConfig) -> str:
    """Scored rows on days of a rising market, as CTE `g`."""
    return f"{base(cfg)}, {levels(cfg)}, {scores(cfg)}, g AS (SELECT sc.* FROM sc JOIN (SELECT sc.as_of AS day, max_by(market_up, mk.bar_date) AS up FROM (SELECT DISTINCT as_of FROM sc) sc JOIN mk ON mk.bar_date <= sc.as_of GROUP BY 1) m ON m.day = sc.as_of AND m.up)"


def trades(cfg: StrategyConfig, earnings: bool = False) -> str:
    extra = f", {EARNINGS}" if earnings else ""
    return f"{gated(cfg)}{extra}, fire AS (SELECT * FROM g WHERE fires), {settled(cfg, 'fire', 'tr', earnings)}"


SUMMARY = """count(*) FILTER (WHERE status <> 'OPEN')::BIGINT AS n, count(*) FILTER (WHERE status = 'WIN')::BIGINT AS wins, count(*) FILTER (WHERE status = 'LOSS')::BIGINT AS losses, count(*) FILTER (WHERE status = 'EXPIRED')::BIGINT AS expired, count(*) FILTER (WHERE status = 'OPEN')::BIGINT AS open,
    avg(pnl_pct) FILTER (WHERE status <> 'OPEN') AS avg_pnl_pct, coalesce(sum(pnl_pct) FILTER (WHERE status <> 'OPEN'), 0.0) AS total_pnl_pct, CASE WHEN count(pnl_pct) FILTER (WHERE status <> 'OPEN') > 0 THEN coalesce(stddev_samp(pnl_pct) FILTER (WHERE status <> 'OPEN'), 0.0) END AS std_pnl_pct"""


def summary(source: str, by: str = "") -> str:
    """Rounded summary rows of a trades CTE."""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"SELECT {head}n, wins, losses, expired, open, round(avg_pnl_pct, 6) AS avg_pnl_pct, round(total_pnl_pct, 6) AS total_pnl_pct, round(std_pnl_pct, 6) AS std_pnl_pct, round(wins * 100.0 / nullif(n, 0), 6) AS win_rate_pct, CASE WHEN std_pnl_pct > 0 THEN round(avg_pnl_pct / std_pnl_pct, 6) END AS sharpe_like FROM (SELECT {head}{SUMMARY} FROM {source} {group})"


def weighted(source: str, by: str = "") -> str:
    """Rounded weighted summary rows of a CTE with pnl_pct, status and weight, all resolved."""
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT {head}count(*)::BIGINT AS n, round(any_value(wm), 6) AS w_mean, round(sqrt(sum(weight * (pnl_pct - wm) ** 2) / sum(weight)), 6) AS w_std, round(sum(CASE WHEN status = 'WIN' THEN weight ELSE 0 END) / sum(weight) * 100, 6) AS w_win_rate_pct, CASE WHEN sqrt(sum(weight * (pnl_pct - wm) ** 2) / sum(weight)) > 0 THEN round(any_value(wm) / sqrt(sum(weight * (pnl_pct - wm) ** 2) / sum(weight)), 6) END AS w_sharpe_like, round(sum(weight) ** 2 / sum(weight * weight), 6) AS kish_n FROM (SELECT *, sum(weight * pnl_pct) OVER ({part}) / sum(weight) OVER ({part}) AS wm FROM {source}) {group}"


def clustered(source: str, by: str = "") -> str:
    part = f"{by}, " if by else ""
    return f"SELECT *, CASE WHEN coalesce(sector, 'Unknown') = 'Unknown' THEN 1.0 ELSE 1.0 / count(*) OVER (PARTITION BY {part}entry_date, sector) END AS weight FROM {source} WHERE status <> 'OPEN'"
