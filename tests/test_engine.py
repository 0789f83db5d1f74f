"""Hand-made bars, brute force and invariants."""

import datetime as dt
import os
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidebar.config import StrategyConfig
from tidebar.operators import allocation, halo, incremental, indicators, joins, lengths, metrics, selection, trades
from tidebar.sources import layout, readers, tables, versions
from tidebar.streaming import daily

DAY = dt.date(2024, 1, 1)


def bars(spark, rows, ticker="A"):
    """Rows (open, high, low, close[, volume])."""
    data = [(ticker, DAY + dt.timedelta(days=i), *[None if x is None else float(x) for x in r[:4]], float(r[4]) if len(r) > 4 else 100.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ticker string, bar_date date, open double, high double, low double, close double, volume double")


def test_wilder_matches_a_loop_over_blocks(spark):
    rng = random.Random(1)
    xs = [None, None] + [rng.random() * 10 for _ in range(700)]
    df = bars(spark, [(1, 1, 1, x) for x in xs])
    got = [r["y"] for r in indicators.wilder(df, "close", 3, "y").orderBy("bar_date").collect()]
    y, seen = None, 0
    for x, g in zip(xs, got, strict=True):
        if x is not None:
            y = x if y is None else y + (x - y) / 3
            seen += 1
        assert (g is None) == (x is None or seen < 3)
        if g is not None:
            assert g == pytest.approx(y, rel=1e-12)


def test_streak_breaks_at_null(spark):
    df = bars(spark, [(1, 1, 1, c) for c in (5, 1, 1, None, 1, 1, 1, 9)])
    got = [r["s"] for r in indicators.streak(df, F.col("close") < 2, "s").orderBy("bar_date").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3, 0]


def test_support_date_is_the_first_of_ties(spark):
    df = bars(spark, [(1, 1, low, 1) for low in (3, 2, 2, 4)])
    low, day = indicators.support(4)
    assert df.select(day.alias("d"), "bar_date").orderBy("bar_date").collect()[3]["d"] == DAY + dt.timedelta(days=1)


EXITS = {
    "gap_down_stop": ([(90, 95, 89, 94)], "LOSS", 90.0, 1),
    "gap_up_target": ([(120, 121, 119, 120)], "WIN", 120.0, 1),
    "stop_hit_intraday": ([(100, 116, 94, 100)], "LOSS", 94.905, 1),  # stop and target in one bar: stop
    "target_hit": ([(100, 105, 99, 100), (100, 116, 99, 100)], "WIN", 115.0, 2),
    "expired": ([(100, 101, 99, 100.5)] * 3, "EXPIRED", 100.5, 3),
}


@pytest.mark.parametrize("reason", EXITS)
def test_exit_rules(spark, reason):
    after, status, price, days = EXITS[reason]
    df = trades.with_ahead(bars(spark, [(100, 100, 100, 100), *after]), 3).orderBy("bar_date").limit(1)
    df = df.withColumn("buy", F.lit(100.0)).withColumn("stop", F.lit(95.0)).withColumn("target", F.lit(115.0))
    r = trades.resolve(df, "ahead", "buy", "stop", "target", 3, 0.001, 0.0).first()
    assert (r["status"], r["exit_reason"], r["holding_days"]) == (status, reason, days)
    assert r["exit_price"] == pytest.approx(price, abs=0.006)


def test_open_when_bars_run_out_and_stop_wins_over_expiry(spark):
    df = trades.with_ahead(bars(spark, [(100, 100, 100, 100), (100, 101, 99, 100), (100, 101, 94, 100)]), 2).orderBy("bar_date").limit(1)
    df = df.withColumn("buy", F.lit(100.0)).withColumn("stop", F.lit(95.0)).withColumn("target", F.lit(115.0))
    assert trades.resolve(df, "ahead", "buy", "stop", "target", 2, 0.0, 0.0).first()["exit_reason"] == "stop_hit_intraday"
    assert trades.resolve(df.withColumn("stop", F.lit(1.0)), "ahead", "buy", "stop", "target", 9, 0.0, 0.0).first()["status"] == "OPEN"


def test_fills(spark):
    rows = [(100, 100, 100, 100), (101, 102, 100.5, 101), (101, 102, 99, 101), (98, 99, 97, 98)]
    first = trades.with_ahead(bars(spark, rows), 5).orderBy("bar_date").limit(1)
    limit = lambda p, w: first.select(trades.limit_fill(F.col("ahead"), F.lit(p), w).alias("f")).first()["f"]
    assert (limit(101.5, 5)["k"], limit(101.5, 5)["price"]) == (1, 101.0)  # at the open
    assert (limit(99.5, 5)["k"], limit(99.5, 5)["price"]) == (2, 99.5)  # touched
    assert limit(98.5, 3)["price"] == 98.0 and limit(98.5, 2) is None and limit(50.0, 5) is None
    stop = lambda p: first.select(trades.stop_fill(F.col("ahead"), F.lit(p), 5).alias("f")).first()["f"]
    assert stop(100.9)["price"] == 101.0 and stop(101.7)["price"] == 101.7 and stop(103.0) is None


def test_retest_days(spark):
    cfg = StrategyConfig(breakout_lookback=2)
    closes = [10, 10, 12, 11, 11]
    df = indicators.with_indicators(bars(spark, [(c, c, c, c) for c in closes]), cfg).orderBy("bar_date")
    assert [r["days_since_breakout"] for r in df.collect()] == [None, None, 0, 1, 2]


def trade_rows(spark, rows):
    return spark.createDataFrame([(f"T{i}", s, DAY + dt.timedelta(days=d), DAY, st, p) for i, (s, d, st, p) in enumerate(rows)], "ticker string, sector string, entry_date date, signal_date date, status string, pnl_pct double")


def test_summaries_of_none_one_and_many(spark):
    none = metrics.summary(trade_rows(spark, []).where("false")).first()
    assert none["n"] == 0 and none["avg_pnl_pct"] is None and none["total_pnl_pct"] == 0.0
    one = metrics.summary(trade_rows(spark, [("x", 0, "WIN", 2.0), ("x", 0, "OPEN", None)])).first()
    assert (one["n"], one["open"], one["std_pnl_pct"], one["sharpe_like"]) == (1, 1, 0.0, None)
    w = metrics.weighted_summary(metrics.cluster_weights(trade_rows(spark, [("x", 0, "WIN", 2.0), ("x", 0, "LOSS", -1.0), ("Unknown", 0, "WIN", 4.0)]))).first()
    assert w["w_mean"] == pytest.approx((0.5 * 2 - 0.5 + 4) / 2) and w["kish_n"] == pytest.approx(4 / 1.5)


def test_drawdown(spark):
    df = trade_rows(spark, [("x", 0, "WIN", 10.0), ("x", 1, "LOSS", -20.0), ("x", 2, "LOSS", -100.0)]).withColumn("g", F.lit(1))
    assert metrics.max_drawdown(df.where("pnl_pct > -100"), ["g"]).first()["max_drawdown_pct"] == 20.0
    assert metrics.max_drawdown(df, ["g"]).first()["max_drawdown_pct"] == 100.0


def test_allocation_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("A", "x", "Buy", 90.0, 700.0), ("B", "x", "Buy", 80.0, 400.0), ("C", "x", "Buy", 70.0, 200.0), ("D", "y", "Buy", 60.0, 90.0), ("E", None, "Watch", 50.0, 1.0)], "ticker string, sector string, signal string, trade_score double, est_cost double").withColumn("pool", F.lit(1))
    got = {r["ticker"]: r["final_signal"] for r in allocation.allocate(rows, ["pool"], 1000.0, cap_share=0.8).collect()}
    assert got == {"A": "Buy", "B": "Insufficient Funds", "C": "Sector Limit Reached", "D": "Buy", "E": "Watch"}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("A", "2024-01-01", "rsi", 1.0, True, None)], "ticker string, signal_date string, strategy string, score double, confirmed_filled boolean, created_at timestamp")
    new = spark.createDataFrame([("A", "2024-01-01", "rsi", 2.0), ("B", "2024-01-01", "rsi", 3.0)], "ticker string, signal_date string, strategy string, score double")
    once = tables.upsert(old, new, now="2024-02-02")
    assert sorted(once.collect()) == sorted(tables.upsert(once, new, now="2024-02-02").collect())
    assert {(r["ticker"], r["score"], r["confirmed_filled"]) for r in once.collect()} == {("A", 2.0, True), ("B", 3.0, None)}


def test_promotion(spark):
    c = tables.add_candidate(spark.createDataFrame([(1, "active", "{}", None, None, None, "")], "version int, status string, params string, metrics map<string,double>, created_at timestamp, promoted_at timestamp, notes string"), "{}", {"m": 1.0}, "n", "2024-01-01")
    assert {r["version"]: r["status"] for r in tables.promote(c, 2, "2024-01-02").collect()} == {1: "retired", 2: "active"}
    with pytest.raises(Exception, match="no configuration"):
        tables.promote(c, 9, "2024-01-02").collect()


def test_readers(spark):
    text = lambda s: spark.createDataFrame([(s,)], "value string")
    w = readers.watchlist(text('{"watchlist": [" aapl", {"ticker": "msft", "sector": "Tech"}, ""]}')).orderBy("pos").collect()
    assert [(r["ticker"], r["sector"]) for r in w] == [("AAPL", None), ("MSFT", "Tech")]
    lines = lambda s: [r["ticker"] for r in readers.watchlist(text(s)).orderBy("pos").collect()]
    assert lines("ab\n\n c ") == ["AB", "C"] and lines("[1,\nx") == ["[1,", "X"] and lines('{"other": 1}') == ['{"OTHER": 1}']
    assert [r["ticker"] for r in readers.ticker_list(text("b, a\nb  c")).orderBy("pos").collect()] == ["B", "A", "C"]
    assert {tuple(r) for r in readers.holdings_text(text("a,1\nb,x\nA,2,3.5\nc,-1\nd 4 x\ne,5,")).collect()} == {("A", 2.0, 3.5), ("D", 4.0, None), ("E", 5.0, None)}


def test_pareto_keeps_equal_points(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 1.0, 5.0), (2, 2.0, 9.0), (3, 0.5, 6.0), (4, 1.0, 7.0)], "config_id int, objective double, drawdown double")
    assert {r["config_id"] for r in selection.pareto_front(df).collect()} == {0, 1, 2}


def test_no_look_ahead(spark):
    rng = random.Random(3)
    rows = [(p := 50 + rng.random() * 10, p + 2, p - 2, p + rng.random()) for _ in range(80)]
    cfg = StrategyConfig(ma_window=5, sma_trend=10, volume_lookback=5, breakout_lookback=5, week52_lookback=10, support_lookback=5, bb_window=5, squeeze_window=5, obv_window=5)
    columns = ["bar_date", "rsi", "atr", "adx", "highest_high", "squeeze_zscore", "days_since_breakout"]
    whole = indicators.with_indicators(bars(spark, rows), cfg).select(*columns).orderBy("bar_date").collect()
    part = indicators.with_indicators(bars(spark, rows[:60]), cfg).select(*columns).orderBy("bar_date").collect()
    assert whole[:60] == part


def test_sector_map_takes_the_last_trimmed_sector(spark):
    rows = spark.createDataFrame([(0, "A", "X"), (1, "A", " Y "), (2, "A", ""), (3, "A", None), (4, "B", "")], "pos int, ticker string, sector string")
    assert [tuple(r) for r in readers.sector_map(rows).collect()] == [("A", "Y")]


def test_allocation_keeps_repeated_tickers_and_null_pools(spark):
    rows = spark.createDataFrame([(1, "A", "Buy", 9.0, 60.0), (1, "A", "Buy", 8.0, 60.0), (None, "A", "Buy", 7.0, 100.0), (None, "B", "Watch", None, 1.0)], "pool int, ticker string, signal string, trade_score double, est_cost double")
    got = allocation.allocate(rows, ["pool"], 100.0).collect()
    assert sorted(((r["pool"] or 0), r["ticker"], r["spent"], r["allocated"]) for r in got) == [(0, "A", 100.0, 100.0), (0, "B", 0.0, 100.0), (1, "A", 0.0, 60.0), (1, "A", 60.0, 60.0)]


def test_confirmations_in_order(spark):
    key = ("A", "2024-01-01", "rsi")
    signals = spark.createDataFrame([(*key, True, 5.0, None), ("B", *key[1:], None, None, None)], "ticker string, signal_date string, strategy string, confirmed_filled boolean, fill_price double, confirmed_at timestamp")
    event = "ticker string, signal_date string, strategy string, confirmed boolean, fill_price double, at int"

    def after(*events):
        e = spark.createDataFrame([(*key, *x) for x in events], event).withColumn("at", F.timestamp_seconds("at"))
        return {r["ticker"]: (r["confirmed_filled"], r["fill_price"]) for r in tables.confirm(signals, e).collect()}

    assert after((True, 10.0, 1), (True, None, 2)) == {"A": (True, 10.0), "B": (None, None)}
    assert after((True, None, 1))["A"] == (True, 5.0) and after((True, 10.0, 1), (False, None, 2))["A"] == (False, None)
    assert after((True, 10.0, 1), (False, None, 2), (True, None, 3))["A"] == (True, None)


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([("A", "2024-01-01", None, 1.0)], "ticker string, signal_date string, strategy string, score double")
    assert [tuple(r) for r in tables.upsert(old, old.withColumn("score", F.lit(2.0)), now="2024-02-02").collect()] == [("A", "2024-01-01", None, 2.0)]


def test_stream_of_scored_rows_is_upserted(spark, tmp_path):
    """Two runs of the stream over the same rows leave one row a key; readers see whole versions only."""
    schema = "ticker string, signal_date string, strategy string, signal string, score double"
    rows = spark.createDataFrame([("A", "2024-01-01", "rsi", "Buy", 1.0), ("B", "2024-01-01", "rsi", "Ignore", 2.0)], schema)
    table = str(tmp_path / "signals")
    for run, score in (("1", 1.0), ("2", 3.0)):
        rows.withColumn("score", F.lit(score)).write.parquet(str(tmp_path / run))
        daily.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / run)), table, str(tmp_path / f"c{run}"), f"2024-02-0{run}").awaitTermination()
    got = versions.read_table(spark, table).collect()
    assert [(r["ticker"], r["score"], r["tier"], r["created_at"].day, r["updated_at"].day) for r in got] == [("A", 3.0, "actionable", 1, 2)]


def test_market_gate_raises_without_history(spark):
    df = bars(spark, [(1, 1, 1, c) for c in (1, 2, 3)])
    assert joins.market_is_up(df, 3).first()["market_up"]
    with pytest.raises(Exception, match="too short a history"):
        joins.market_is_up(df, 4).collect()
    with pytest.raises(Exception, match="repeated day"):
        joins.market_uptrend(df, df.union(df), 2).collect()


def test_deep_drawdown_over_months(spark):
    rng = random.Random(11)
    rows = [("x", i * 9, "WIN", rng.uniform(-12, 12)) for i in range(80)]
    equity, peak, deep = 1.0, 1.0, 0.0
    for _, _, _, p in rows:
        equity *= 1 + p / 100
        peak = max(peak, equity)
        deep = max(deep, (peak - equity) / peak * 100)
    got = metrics.max_drawdown(trade_rows(spark, rows).withColumn("g", F.lit(1)), ["g"]).first()["max_drawdown_pct"]
    assert got == pytest.approx(deep, abs=0.006)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_product(spark):
    from tidebar.plans import queries

    sf = "/root/testdata/sf0.001"
    for name in ("q_g03_weighted_summary", "q_g05_recency_weighted", "q_j10_settle_signals", "q_t10_walk_forward", "q_t12_sweep"):
        text = plan(queries.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
    assert plan(queries.QUERIES["q_t12_sweep"](spark, sf)).count("lineitem.parquet") <= 4


def test_search_grid_stays_within_bounds():
    for s, space in selection.SEARCH_SPACE.items():
        grid = selection.search_grid(StrategyConfig(strategy=s), 3)
        assert len(grid) <= 1 + 3 * len(space)
        assert all(low <= getattr(c, p) <= high for p, (low, high) in space.items() for c in list(grid.values())[1:] if getattr(c, p) != getattr(StrategyConfig(), p))


def test_windows_of_any_length_match_slices(spark):
    rng = random.Random(3)
    rows = [(1, None if rng.random() < 0.03 else round(rng.uniform(5, 9), 2), 1, None if rng.random() < 0.03 else round(rng.uniform(5, 9), 2)) for _ in range(90)]
    df = lengths.with_lengths(bars(spark, rows), range(1, 40), range(1, 40), [(n, k) for n in range(1, 30, 3) for k in (0, 4)]).orderBy("bar_date").collect()
    for i, r in enumerate(df):
        for n in range(1, 40):
            for name, part in ((f"prior_{n}", rows[max(0, i - n) : i]), (f"high_{n}", rows[max(0, i - n + 1) : i + 1])):
                highs = [x[1] for x in part if x[1] is not None]
                assert r[name] == (max(highs) if len(highs) == n else None)
        for n in range(1, 30, 3):
            for k in (0, 4):
                part = [x[3] for x in rows[max(0, i - k - n + 1) : max(0, i - k + 1)] if x[3] is not None]
                assert r[f"mean_{n}_{k}"] == (pytest.approx(sum(part) / n, rel=1e-14) if len(part) == n else None)


def test_search_points_fill_the_bounds():
    for s, space in selection.SEARCH_SPACE.items():
        points = selection.search_points(StrategyConfig(strategy=s), 64, 1)
        assert len(points) == 65 and points == selection.search_points(StrategyConfig(strategy=s), 64, 1) != selection.search_points(StrategyConfig(strategy=s), 64, 2)
        for p, (low, high) in space.items():
            values = [getattr(c, p) for c in list(points.values())[1:]]
            quarters = {min(3, int(4 * (v - low) / (high - low))) for v in values}
            assert all(low <= v <= high for v in values) and quarters == {0, 1, 2, 3}


def test_sweep_of_mixed_lengths_equals_single_configurations(spark):
    from tidebar.plans import queries
    from tidebar.sources import bars as B

    b, m = B.panel(spark, "/root/testdata/sf0.001")
    for s in ("breakout", "rsi"):
        configs = {i: c for i, c in queries.POINTS[s].items() if i in (0, 3)}
        both = selection.sweep(b, m, configs)
        columns = ["ticker", "signal_date", "entry_date", "status", "pnl_pct"]
        for i, c in configs.items():
            one = sorted(map(str, trades.make_trades(b, m, c).select(*columns).collect()))
            assert one == sorted(map(str, both.where(f"config_id = {i}").select(*columns).collect()))


def test_market_bars_from_parts(spark):
    from tidebar.sources import bars as B

    b, m = B.panel(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, m.collect())) == sorted(map(str, B.market_bars(spark, "/root/testdata/sf0.001").select(*m.columns).collect()))
    assert sorted(map(str, b.collect())) == sorted(map(str, B.weekly_bars(spark, "/root/testdata/sf0.001").select(*b.columns).collect()))


def test_spans_equal_whole_tickers(spark):
    rng = random.Random(8)
    rows, price = [], 50.0
    for i in range(900):
        price = max(5.0, price + rng.uniform(-2, 2) - (0.5 if 300 < i < 640 else 0))
        o = price + rng.uniform(-1, 1)
        rows.append((o, None if i % 97 == 5 else max(o, price) + 1, min(o, price) - 1, price, 100 + i % 7))
    df = bars(spark, rows, "A").unionByName(bars(spark, rows[:150], "B")).withColumn("sector", F.lit("S"))
    # Trends of hundreds of bars: streaks and breakouts cross spans.
    cfg = StrategyConfig(ma_window=5, sma_trend=20, volume_lookback=5, breakout_lookback=60, week52_lookback=30, support_lookback=5, rsi_window=3, atr_window=3, adx_window=3, bb_window=5, squeeze_window=9, pullback_ma=5, pullback_slope=3, obv_window=5, rsi_oversold=99.9)
    assert halo.look_back(cfg) < 250
    columns = ["ticker", "bar_date", "rn", "obv", "oversold_streak_days", "extended_decline_warning", "days_since_breakout", "last_breakout_level", "breakout_flag", "sma_trend", "week52_high", "support_date", "rsi", "adx", "atr", "obv_zscore", "squeeze_zscore"]
    want = indicators.with_indicators(df, cfg).select(*columns).orderBy("ticker", "bar_date").collect()
    got = halo.with_indicators_by_span(df, cfg, span=10).select(*columns).orderBy("ticker", "bar_date").collect()
    assert len(got) == len(want) == 1050
    assert max(r["oversold_streak_days"] for r in want) > 260
    for a, b in zip(got, want, strict=True):
        for c in columns:
            assert a[c] == (pytest.approx(b[c], rel=1e-9, abs=1e-9) if isinstance(b[c], float) else b[c]), (c, a["bar_date"])


def test_short_tickers_and_spans_of_whole_bars(spark):
    """Windows put together from powers of two and sums without blocks equal the plain ones; so do spans of bars with all prices."""
    from tidebar.operators import short

    cfg = StrategyConfig(ma_window=7, sma_trend=20, volume_lookback=5, breakout_lookback=9, week52_lookback=31, support_lookback=6, rsi_window=3, atr_window=4, adx_window=3, bb_window=7, squeeze_window=9, pullback_ma=8, pullback_slope=3, obv_window=5, rsi_oversold=60.0)
    # Gaps, few bars, and one price for longer than all windows.
    flat = bars(spark, [(5.1, 5.1, 5.1, 5.1, 3)] * 60 + [(6.0, 6.5, 5.5, 6.1, 4)] * 30, "C")
    df = random_bars(spark, 300).unionByName(random_bars(spark, 5, "B", 9)).unionByName(flat)
    for c in (cfg, replace(cfg, atr_window=3, rsi_window=1)):
        want = indicators.with_indicators(df, c).drop("relative_strength").orderBy("ticker", "bar_date")
        got = short.with_indicators(df, c).select(*want.columns).orderBy("ticker", "bar_date")
        close_rows(got.collect(), want.collect())
    whole = random_bars(spark, 700, gaps=False).unionByName(random_bars(spark, 90, "B", 9, gaps=False))
    c = replace(cfg, breakout_lookback=60)
    assert halo.look_back(c) < 250 and short.fits(c, 500) and not short.fits(c, 5000)
    want = indicators.with_indicators(whole, c).orderBy("ticker", "bar_date")
    close_rows(halo.with_indicators_by_span(whole, c, span=10, whole_bars=True).select(*want.columns).orderBy("ticker", "bar_date").collect(), want.collect())


def close_rows(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        for c, x, y in zip(b.__fields__, a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y), (c, a["ticker"], a["bar_date"])


def test_spans_are_shuffled_once_and_nothing_is_written(spark):
    from tidebar.plans import queries

    shared = spark.conf.get("spark.checkpoint.dir")
    before = sorted(os.listdir(shared))
    out = queries.QUERIES["q_w25_indicators_by_span"](spark, "/root/testdata/sf0.001")
    assert out.collect()
    assert sorted(os.listdir(shared)) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    # The lines and the spans are read twice each from one shuffle; the rows themselves are not sent again.
    assert re.search(r"ReusedExchange \[[^\]]*l_orderkey", final) and re.search(r"ReusedExchange \[[^\]]*__home", final)
    sent = re.findall(r"Exchange hashpartitioning\(([a-z_]*)", re.sub(r"ReusedExchange.*", "", final))
    assert sent.count("cast") == sent.count("ticker") == 1, sent


def test_no_span_is_a_look_back_only(spark):
    """The end of a ticker is sent nowhere else: 150 and 100 bars in spans of 100 are 250 rows and one look-back of 80."""
    rows = [(1.0, 2.0, 0.5, 1.0 + i % 3, 10) for i in range(150)]
    df = bars(spark, rows, "A").unionByName(bars(spark, rows[:100], "B"))
    got = halo.in_spans(df, 100, 80).groupBy("ticker", "__span").agg(F.count("*").alias("n"), F.count_if(F.expr("__home = __span")).alias("own")).orderBy("ticker", "__span").collect()
    assert [tuple(r) for r in got] == [("A", 0, 100, 100), ("A", 1, 130, 50), ("B", 0, 100, 100)]


def random_bars(spark, n, ticker="A", seed=8, gaps=True):
    rng = random.Random(seed)
    rows, price = [], 50.0
    for i in range(n):
        price = max(5.0, price + rng.uniform(-2, 2))
        o = price + rng.uniform(-1, 1)
        rows.append((o, None if gaps and i % 17 == 5 else max(o, price) + 1, min(o, price) - 1, None if gaps and i % 23 == 11 else price, 100 + i % 7))
    return bars(spark, rows, ticker)


BRISK = StrategyConfig(ma_window=5, sma_trend=12, volume_lookback=5, breakout_lookback=6, week52_lookback=15, support_lookback=5, rsi_window=4, atr_window=5, adx_window=5, pullback_ma=5, pullback_slope=3, obv_window=5)


def test_states_moved_by_a_stream_equal_a_batch(spark, tmp_path):
    from tidebar.streaming import indicators as stream

    df = random_bars(spark, 90).unionByName(random_bars(spark, 60, "B", 9)).unionByName(random_bars(spark, 90, "C", 10).where("bar_date >= date'2024-03-20'")).withColumn("sector", F.lit("S"))
    cut = DAY + dt.timedelta(days=60)
    stream.start_from(incremental.state_after(df.where(F.col("bar_date") < F.lit(cut)), BRISK), str(tmp_path / "out"))
    for i in range(30):  # a file a day, taken one at a time
        df.where(F.col("bar_date") == F.lit(cut + dt.timedelta(days=i))).drop("sector").coalesce(1).write.parquet(str(tmp_path / "in" / f"d{i:02d}"))
    source = spark.readStream.schema(df.drop("sector").schema).option("maxFilesPerTrigger", 5).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream.indicator_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), BRISK).awaitTermination()
    got = {(r["ticker"], r["bar_date"]): r for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    want = indicators.with_indicators(df, BRISK).where(F.col("bar_date") >= F.lit(cut)).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w["ticker"], w["bar_date"]]
        for c in incremental.ROW:
            assert g[c] == (pytest.approx(w[c], rel=1e-9, abs=1e-9) if isinstance(w[c], float) else w[c]), (c, w["ticker"], w["bar_date"])


def test_a_batch_that_comes_again_changes_nothing(spark):
    df = random_bars(spark, 40)
    once = incremental.advance(incremental.empty_state(spark), df, BRISK)
    again = incremental.advance(once, df.where("bar_date > date'2024-01-20'"), BRISK)
    assert incremental.rows_of(again).count() == 0 and incremental.rows_of(once).count() == 40
    assert once.drop("out").collect() == again.drop("out").collect()
    state = incremental.state_after(df, BRISK).select(*once.drop("out").columns).first().asDict(True)
    for k, v in once.drop("out").first().asDict(True).items():
        near = lambda x: None if x is None else pytest.approx(x, rel=1e-9)
        assert state[k] == (near(v) if isinstance(v, float) else [near(x) for x in v] if k == "averages" else v), k


def test_an_upsert_writes_its_months_only_and_old_versions_go(spark, tmp_path):
    schema = "ticker string, signal_date string, strategy string, tier string, confirmed_filled boolean, fill_price double, confirmed_at timestamp"
    make = lambda *rows: spark.createDataFrame([(t, d, "rsi", x, None, None, None) for t, d, x in rows], schema)
    path = str(tmp_path / "t")
    assert versions.upsert_months(make(("A", "2024-01-05", "x"), ("B", "2024-02-05", "x"), ("C", None, "x")), path, "2024-03-01") == ["2024-01", "2024-02", "none"]
    before = versions.manifest(spark, path)[1]["partitions"]
    assert versions.upsert_months(make(("B", "2024-02-05", "y"), ("B", "2024-02-06", "y")), path, "2024-03-02") == ["2024-02"]
    after = versions.manifest(spark, path)[1]["partitions"]
    assert {p for p in after if after[p] != before.get(p)} == {"2024-02"}
    got = sorted((r["ticker"], str(r["signal_date"]), r["tier"], r["created_at"].day, r["updated_at"].day) for r in versions.read_table(spark, path).collect())
    assert got == [("A", "2024-01-05", "x", 1, 1), ("B", "2024-02-05", "y", 1, 2), ("B", "2024-02-06", "y", 2, 2), ("C", "None", "x", 1, 1)]
    for k in range(4):
        versions.upsert_months(make(("B", "2024-02-05", f"z{k}")), path, "2024-03-03")
    assert len(list((tmp_path / "t" / "manifest").glob("[0-9]*"))) == versions.KEEP
    assert {r["tier"] for r in versions.read_table(spark, path, ["2024-02"]).collect()} == {"y", "z3"} and versions.read_table(spark, path).count() == 4
    assert len(list((tmp_path / "t" / "data").glob("*/__month=2024-02"))) == versions.KEEP
    n, m = versions.manifest(spark, path)
    with pytest.raises(versions.ConcurrentWrite):
        versions.commit(spark, path, n, m)
    versions.replace_all(make(("Q", "2024-01-01", "q")), str(tmp_path / "w"))
    versions.replace_all(versions.read_table(spark, str(tmp_path / "w")).limit(0), str(tmp_path / "w"))
    assert versions.read_table(spark, str(tmp_path / "w")).count() == 0
    with pytest.raises(ValueError, match="one whole"):
        versions.upsert_months(make(("A", "2024-01-05", "x")), str(tmp_path / "w"))


def test_windows_over_laid_out_bars_exchange_nothing(spark):
    df = random_bars(spark, 60, gaps=False).unionByName(random_bars(spark, 40, "B", 9, False))
    layout.save_bars(df.where("bar_date < date'2024-02-01'"), "laid_out", 2)
    whole = layout.read_bars(spark, "laid_out")
    w = lambda t: t.withColumns({"h": indicators.prior_high(5), "m": indicators.sma("close", 5)})
    assert "Exchange" not in plan(w(whole)) and "Sort " not in plan(w(whole))
    assert "Exchange" not in plan(indicators.adx(whole, 5))
    layout.append_day(df.where("bar_date >= date'2024-02-01'"), "laid_out")
    later = layout.read_bars(spark, "laid_out")
    assert "Exchange" not in plan(w(later))
    columns = ["ticker", "bar_date", "h", "m"]
    assert sorted(map(str, w(later).select(*columns).collect())) == sorted(map(str, w(df).select(*columns).collect()))
    spark.sql("DROP TABLE laid_out")


def test_small_spreads_about_large_means(spark):
    rows = [(None, 1000.0 + i * 1e-4, "WIN", 1.0 + i % 2) for i in range(10)]
    df = spark.createDataFrame([("g", p, s, w) for _, p, s, w in rows] + [("h", 0.1, "LOSS", 1 / 3)] * 7, "g string, pnl_pct double, status string, weight double")
    got = {r["g"]: r for r in metrics.weighted_summary(df, ["g"]).collect()}
    total = sum(w for *_, w in rows)
    mean = 1000.0 + sum(w * i * 1e-4 for i, (*_, w) in enumerate(rows)) / total
    assert got["g"]["w_std"] == pytest.approx((sum(w * (p - mean) ** 2 for _, p, _, w in rows) / total) ** 0.5, rel=1e-6)
    assert (got["h"]["w_std"], got["h"]["w_sharpe_like"], got["h"]["n"]) == (0.0, None, 7)


def test_the_last_index_bar_holds_on_without_an_end(spark):
    day = lambda y: dt.date(y, 1, 3)
    left = spark.createDataFrame([(day(y),) for y in (1999, 2000, 2005, 2055)], "bar_date date")
    right = spark.createDataFrame([(day(2000), 7)], "bar_date date, x int")
    assert [r["x"] for r in joins.asof_calendar(left, right, ["x"]).orderBy("bar_date").collect()] == [None, 7, 7, 7]


def test_spells_of_members(spark):
    d = lambda m: dt.date(2024, m, 1)
    snaps = spark.createDataFrame([(d(1), ["A", "B"]), (d(2), ["A"]), (d(3), ["A", "B", "B"]), (d(5), ["C", "A"])], "snapshot_date date, tickers array<string>")
    spells = readers.membership_spells(snaps)
    assert sorted(map(tuple, spells.collect()), key=str) == sorted([("A", None, None), ("B", None, d(2)), ("B", d(3), d(5)), ("C", d(5), None)], key=str)
    days = [dt.date(2023, 1, 1), d(1), d(2), dt.date(2024, 4, 30), d(5), d(9)]
    rows = spark.createDataFrame([(t, x) for t in "ABCD" for x in days], "ticker string, day date")
    for x in days:
        want = {r["ticker"] for r in readers.members_as_of(snaps, x).collect()}
        assert {r["ticker"] for r in joins.members_then(rows, spells, "day").where(F.col("day") == F.lit(x)).collect()} == want


def test_allocation_in_chunks_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"T{rng.randint(0, 400):03d}", rng.choice(["Buy", "Strong Buy", "Watch"]), float(rng.randint(40, 99)), rng.choice([round(rng.uniform(1, 60), 2), 0.5]), rng.choice(["a", "b", "c", None]), rng.choice([1, 1, 2, None])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "ticker string, signal string, trade_score double, est_cost double, sector string, day int")
    held = spark.createDataFrame([("X", "a", 300.0), ("Y", None, 50.0)], "ticker string, sector string, amount double")
    got = allocation.allocate(df, ["day"], 4000.0, cap_share=0.25, holdings=held, chunk=100).collect()
    want = []
    for day in (None, 1, 2):
        left, by, mine = 4000.0, {"a": 300.0}, []
        for r in sorted((r for r in rows if r[5] == day), key=lambda r: (-r[2], r[0], r[1], r[3], r[4] is not None, r[4] or "")):
            label, spent = r[1], 0.0
            if r[1] != "Watch":
                if r[3] > left:
                    label = "Insufficient Funds"
                elif r[4] is not None and by.get(r[4], 0.0) + r[3] > 0.25 * 4350.0:
                    label = "Sector Limit Reached"
                else:
                    spent = r[3]
                    left -= spent
                    if r[4] is not None:
                        by[r[4]] = by.get(r[4], 0.0) + spent
            mine.append([*r, label, spent])
        want += [(*r, pytest.approx(4000.0 - left)) for r in mine]
    key = lambda r: str(tuple(r)[:8])
    assert sorted(map(key, got)) == sorted(map(key, want)) and {r["final_signal"] for r in got} == {"Buy", "Strong Buy", "Watch", "Insufficient Funds", "Sector Limit Reached"}
    assert {(r["day"], round(r["allocated"], 6)) for r in got} == {(r[5], round(r[8].expected, 6)) for r in want}
    assert allocation.allocate(df.limit(0), ["day"], 1.0).count() == 0
