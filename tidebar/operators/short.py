"""The indicators of tickers that are short, as spans are: one sort, and a bar costs the logarithm of a window's length.

Where no ticker has more than some hundred or thousand bars, r^-t stays in the range of a double, so
smoothed values are one running sum without blocks.  Sums, spreads and maxima over n bars are put together
from those over powers of four, each of four of a quarter of its length; what is null in one is null in
all that hold it, so a window is null until all its bars are known.  Columns are added level by
level, all that depend on the same level in one window operator, and a column of some bars ago
is made once for all that read it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StrategyConfig
from .indicators import by_ticker, directional, moves, ranges, strength


def fits(cfg: StrategyConfig, at_most: int) -> bool:
    """Whether r^-t stays in the range of a double for so many values, with r = 1 - 1/n of each smoothing."""
    return all(n == 1 or at_most * -math.log(1.0 - 1.0 / n) < 600.0 for n in (cfg.rsi_window, cfg.atr_window, cfg.adx_window))


class Levels:
    """Columns to add, each at the level after those that its windows read."""

    def __init__(self, columns: list[str]):
        self.level = dict.fromkeys(columns, 0)
        self.steps: dict[tuple[int, int], dict[str, Column]] = {}
        self.added: list[str] = []

    def window(self, name: str, column: Column, *reads: str) -> str:
        return self._put(name, column, max((self.level[x] for x in reads), default=0) + 1, 0)

    def plain(self, name: str, column: Column, *reads: str) -> str:
        """A column without windows; it may read plain ones of its level that were added before.  None comes before the first windows, as it would be shuffled as well."""
        return self._put(name, column, max(1, *(self.level[x] for x in reads)), len(self.added) + 1)

    def _put(self, name: str, column: Column, level: int, place: int) -> str:
        if name not in self.added:
            self.added.append(name)
            self.level[name] = level
            self.steps.setdefault((level, place), {})[name] = column
        return name

    def added_to(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, at: d.withColumns(self.steps[at]), sorted(self.steps), df)


def ago(c: Levels, x: str, k: int) -> str:
    """The column of k bars ago."""
    return c.window(f"__{x}_{k}_ago", F.lag(x, k).over(by_ticker()), x) if k else x


def power(n: int) -> int:
    return 1 if n < 4 else 4 * power(n // 4)


def parts(n: int) -> list[tuple[int, int]]:
    """n as smaller powers of four, the largest first, with the number of bars after each."""
    out, after = [], 0
    while after < n:
        p = power(n - after) if power(n) < n else n // 4
        out.append((p, after))
        after += p
    return out


def added(xs: list[Column]) -> Column:
    """The sum in pairs, so that four equal values give exactly four times one."""
    return xs[0] if len(xs) == 1 else added(xs[: (len(xs) + 1) // 2]) + added(xs[(len(xs) + 1) // 2 :])


def sum_over(c: Levels, x: str, n: int) -> str:
    """Sum over n bars."""
    if n == 1:
        return x
    names = [ago(c, sum_over(c, x, p), k) for p, k in parts(n)]
    return c.plain(f"__sum_{x}_{n}", added([F.col(s) for s in names]), *names)


def spread_over(c: Levels, x: str, n: int) -> str:
    """Sum of squared distances from the mean over n bars: those of the parts, and of the parts' means in pairs (exactly 0 where all values are one)."""
    if n == 1:
        return c.plain(f"__spread_{x}_1", F.lit(0.0) * F.col(x), x)
    pieces = parts(n)
    sums, spreads = [ago(c, sum_over(c, x, p), k) for p, k in pieces], [ago(c, spread_over(c, x, p), k) for p, k in pieces if p > 1]
    means = [(F.col(s) / p, p) for s, (p, _) in zip(sums, pieces, strict=True)]
    pairs = [(a - b) * (a - b) * (p * q / n) for i, (a, p) in enumerate(means) for b, q in means[:i]]
    return c.plain(f"__spread_{x}_{n}", added([F.col(s) for s in spreads] + pairs), *sums, *spreads)


def highest_over(c: Levels, x: str, n: int, out: str | None = None, skip: int = 0) -> str:
    """Maximum of n bars up to the one `skip` bars ago; its parts may overlap."""
    p = power(n) if power(n) < n else max(1, n // 4)
    top = x if p == 1 else highest_over(c, x, p)
    names = [ago(c, top, min(k, n - p) + skip) for k in range(0, n, p)]
    highest = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return c.plain(out or f"__high_{x}_{n}", F.when(reduce(lambda a, b: a & b, (F.col(s).isNotNull() for s in names)), highest), *names)


def lowest_over(c: Levels, x: str, n: int) -> str:
    """Minimum of at most n bars."""
    if n == 1:
        return x
    p = power(n) if power(n) < n else n // 4
    least = lowest_over(c, x, p)
    names = [ago(c, least, min(k, n - p)) for k in range(0, n, p)]
    return c.plain(f"__low_{x}_{n}", F.least(*names), *names)


def smooth(c: Levels, outs: dict[str, str], n: int) -> None:
    """As `indicators.wilder_all`, in one block."""
    if n == 1:
        for x, y in outs.items():
            c.plain(y, F.col(x), x)
        return
    running, r = by_ticker().rowsBetween(Window.unboundedPreceding, 0), 1.0 - 1.0 / n
    known = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in outs))
    tag = next(iter(outs.values()))
    t = c.window(f"__t_{tag}", F.when(known, F.count_if(known).over(running) - 1), *outs)
    # The first value weighs 1, all others 1 / n.
    weight = c.plain(f"__w_{tag}", F.when(F.col(t) == 0, 1.0).otherwise(F.pow(F.lit(r), -F.col(t)) / n), t)
    fade = c.plain(f"__f_{tag}", F.when(F.col(t) >= n - 1, F.pow(F.lit(r), F.col(t))), t)
    for x, y in outs.items():
        c.window(y, F.sum(F.col(x) * F.col(weight)).over(running) * F.col(fade), x, weight, fade)


def mean(c: Levels, out: str, x: str, n: int) -> None:
    s = sum_over(c, x, n)
    c.plain(out, F.col(s) / n, s)


def z_score(c: Levels, out: str, x: str, n: int) -> None:
    s, q = sum_over(c, x, n), spread_over(c, x, n)
    c.plain(out, F.try_divide(F.col(x) - F.col(s) / n, F.sqrt(F.try_divide(F.col(q), F.lit(n - 1.0)))), x, s, q)


def with_indicators(bars: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """The columns of `indicators.with_indicators` without relative strength."""
    w = by_ticker()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    c = Levels(bars.columns)
    prices = [ago(c, x, 1) for x in ("close", "high", "low")]
    before = lambda x: F.col(ago(c, x, 1))
    for name, column in (moves(before) | ranges(before)).items():
        c.plain(name, column, "close", "high", "low", *prices)
    smooth(c, {"__up": "__gain", "__down": "__loss"}, cfg.rsi_window)
    c.plain("rsi", strength(), "__gain", "__loss")
    tr = "atr" if cfg.atr_window == cfg.adx_window else "__atr"
    smooth(c, {"__tr": tr, "__plus": "__pdm", "__minus": "__mdm"}, cfg.adx_window)
    if tr != "atr":
        smooth(c, {"__tr": "atr"}, cfg.atr_window)
    c.plain("__dx", directional(tr), tr, "__pdm", "__mdm")
    smooth(c, {"__dx": "adx"}, cfg.adx_window)

    c.window("rn", F.row_number().over(w))
    for out, x, n in (("sma", "close", cfg.ma_window), ("sma_trend", "close", cfg.sma_trend), ("ma_pullback", "close", cfg.pullback_ma), ("avg_volume", "volume", cfg.volume_lookback)):
        mean(c, out, x, n)
    for out, x, k in (("ma_pullback_prior", "ma_pullback", cfg.pullback_slope), ("avg_volume_prior", "avg_volume", 1)):
        c.plain(out, F.col(ago(c, x, k)), ago(c, x, k))
    c.plain("volume_ratio", F.try_divide(F.col("volume"), F.col("avg_volume_prior")), "volume", "avg_volume_prior")
    c.plain("__lowest", F.when(F.col("low").isNotNull(), F.struct("low", "bar_date")), "low", "bar_date")
    lowest = lowest_over(c, "__lowest", cfg.support_lookback)
    c.plain("support_level", F.col(lowest)["low"], lowest)
    c.plain("support_date", F.col(lowest)["bar_date"], lowest)

    past = ago(c, "close", cfg.breakout_lookback)
    c.plain("k_return", F.try_divide(F.col("close"), F.col(past)) - 1, "close", past)
    highest_over(c, "high", cfg.week52_lookback, "week52_high")
    highest_over(c, "high", cfg.breakout_lookback, "highest_high", 1)
    c.plain("breakout_flag", F.coalesce(F.col("close") > F.col("highest_high"), F.lit(False)), "close", "highest_high")
    since = lambda x: F.last(F.when(F.col("breakout_flag"), F.col(x)), ignorenulls=True).over(running)
    c.window("last_breakout_level", since("highest_high"), "breakout_flag", "highest_high")
    c.window("__out", since("rn"), "breakout_flag", "rn")
    c.plain("days_since_breakout", (F.col("rn") - F.col("__out")).cast("int"), "rn", "__out")

    c.plain("__step", F.coalesce(F.signum(F.col("close") - before("close")) * F.col("volume"), F.lit(0.0)), "volume", *prices)
    c.window("obv", F.sum("__step").over(running), "__step")
    z_score(c, "obv_zscore", "obv", cfg.obv_window)
    s, q = sum_over(c, "close", cfg.bb_window), spread_over(c, "close", cfg.bb_window)
    c.plain("volatility", F.try_divide(F.sqrt(F.try_divide(F.col(q), F.lit(cfg.bb_window - 1.0))), F.col(s) / cfg.bb_window), s, q)
    z_score(c, "__sq", "volatility", cfg.squeeze_window)
    c.window("squeeze_zscore", F.lag("__sq").over(w), "__sq")

    c.plain("__below", F.coalesce(F.col("rsi") < cfg.rsi_oversold, F.lit(False)), "rsi")
    c.window("__above", F.coalesce(F.last(F.when(~F.col("__below"), F.col("rn")), ignorenulls=True).over(running), F.lit(0)), "__below", "rn")
    c.plain("oversold_streak_days", F.when(F.col("__below"), F.col("rn") - F.col("__above")).otherwise(0).cast("int"), "__below", "rn", "__above")
    c.plain("extended_decline_warning", F.col("oversold_streak_days") >= cfg.decline_days, "oversold_streak_days")
    return c.added_to(bars).drop(*(x for x in c.added if x.startswith("__")))
