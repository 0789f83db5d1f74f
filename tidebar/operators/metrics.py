"""Statistics of trades: plain, cluster-weighted, recency-weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_even


def summary(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status and statistics of resolved trades; one resolved trade has deviation 0, none has nulls."""
    done = F.col("status") != "OPEN"
    pnl = F.when(done, F.col("pnl_pct"))
    out = trades.groupBy(*(by or [])).agg(
        F.count_if(done).alias("n"), F.count_if(F.col("status") == "WIN").alias("wins"), F.count_if(F.col("status") == "LOSS").alias("losses"), F.count_if(F.col("status") == "EXPIRED").alias("expired"), F.count_if(~done).alias("open"),
        F.avg(pnl).alias("avg_pnl_pct"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("total_pnl_pct"), F.when(F.count(pnl) > 0, F.coalesce(F.stddev_samp(pnl), F.lit(0.0))).alias("std_pnl_pct"),
    )
    rate = F.try_divide(F.col("wins"), F.col("n")) * 100
    return out.withColumn("win_rate_pct", rate).withColumn("sharpe_like", F.when(F.col("std_pnl_pct") > 0, F.col("avg_pnl_pct") / F.col("std_pnl_pct")))


def cluster_weights(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds weight = 1 / trades of the same entry date and sector; an unknown sector is no cluster."""
    size = F.count("*").over(Window.partitionBy(*(by or []), "entry_date", "sector"))
    return trades.withColumn("weight", F.when(F.coalesce("sector", F.lit("Unknown")) == "Unknown", 1.0).otherwise(1.0 / size))


def weighted_summary(trades: DataFrame, by: list[str] | None = None, weight: str = "weight") -> DataFrame:
    """Weighted mean, population deviation, win rate and effective count over resolved trades.

    Trades of one weight are counted, averaged and spread by Spark's own mergeable moments; those of
    all weights are put together about their common mean, so small spreads about large
    means keep their digits and equal results have none.  Weights are shares of a cluster times those of a fold,
    so there are few of them.
    """
    by = by or []
    x, w = F.col("pnl_pct"), F.col("__w")
    same = trades.where("status <> 'OPEN'").withColumn("__w", F.col(weight)).groupBy(*by, "__w").agg(
        F.count("*").alias("k"), F.count(x).alias("kx"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_if(F.col("status") == "WIN").alias("won"),
    )
    group = Window.partitionBy(*by)
    mean = F.try_divide(F.sum(w * F.col("kx") * F.col("m")).over(group), F.sum(w * F.col("k")).over(group))
    about = w * F.col("kx") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    sums = same.withColumn("mean", mean).groupBy(*by).agg(
        F.sum("k").cast("long").alias("n"), F.sum(w * F.col("k")).alias("sw"), F.sum(w * w * F.col("k")).alias("sww"), F.sum(w * F.col("kx") * F.col("m")).alias("swx"), F.sum(about).alias("m2"),
        F.sum(w * F.col("won")).alias("won"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    some = lambda c: F.when(F.col("sw") > 0, c)
    spread = F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(F.try_divide("m2", "sw"))
    out = sums.select(*by, "n", some(F.try_divide("swx", "sw")).alias("w_mean"), some(F.sqrt(spread)).alias("w_std"), some(F.try_divide("won", "sw") * 100).alias("w_win_rate_pct"), some(F.try_divide(F.col("sw") * F.col("sw"), F.col("sww"))).alias("kish_n"))
    return out.select(*by, "n", "w_mean", "w_std", "w_win_rate_pct", F.when(F.col("w_std") > 0, F.col("w_mean") / F.col("w_std")).alias("w_sharpe_like"), "kish_n")


def inflation_pct(row: DataFrame) -> DataFrame:
    return row.withColumn("inflation_pct", (1 - F.try_divide("kish_n", "n")) * 100)


def recency_weight(end, half_life: float):
    """0.5 to the age of a fold in half-lives; 1 without a half-life."""
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(F.datediff(F.lit(end).cast("date"), F.col("oos_end")), F.lit(0))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def pooled_weighted(fold_trades: DataFrame, end, half_life: float, by: list[str] | None = None) -> DataFrame:
    """Recency times cluster weights over the pooled, resolved out-of-sample trades; clusters span the pool."""
    pool = fold_trades.where("sample = 'oos' AND status <> 'OPEN'")
    pool = cluster_weights(pool, by).withColumn("weight", F.col("weight") * recency_weight(end, half_life))
    return weighted_summary(pool, by)


def by_catalyst(trades: DataFrame) -> DataFrame:
    return summary(trades.withColumn("catalyst_warning", F.coalesce("catalyst_warning", F.lit(False))), ["catalyst_warning"])


def max_drawdown(trades: DataFrame, by: list[str]) -> DataFrame:
    """(by, max_drawdown_pct): of the curve that takes resolved trades in order of entry (then ticker, signal date).

    The curve is a running product: sums of logarithms, with a loss of 100 % or more ending it at zero.
    Two levels, so that no task orders all trades of a curve: each month gives its sum, its highest
    and lowest point and its deepest fall; the months' sums in order put them together.
    """
    grow = 1 + F.col("pnl_pct") / 100
    df = trades.where("status <> 'OPEN'").select(*by, F.trunc("entry_date", "month").alias("__month"), "entry_date", "ticker", "signal_date", (grow <= 0).alias("__dead"), F.when(grow > 0, F.log(grow)).otherwise(0.0).alias("__log"))
    w = Window.partitionBy(*by, "__month").orderBy("entry_date", "ticker", "signal_date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__run", F.sum("__log").over(w)).withColumn("__fall", F.col("__run") - F.max("__run").over(w))
    months = df.groupBy(*by, "__month").agg(F.sum("__log").alias("__sum"), F.max("__run").alias("__high"), F.min("__run").alias("__low"), F.min("__fall").alias("__fall"), F.max("__dead").alias("__dead"))
    earlier = Window.partitionBy(*by).orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)))
    months = months.withColumn("__peak", F.greatest(F.max(F.col("__start") + F.col("__high")).over(earlier), F.lit(0.0)))
    depth = F.when(F.col("__dead"), 1.0).otherwise(1 - F.exp(F.least(F.col("__fall"), F.col("__start") + F.col("__low") - F.col("__peak"))))
    return months.groupBy(*by).agg(round_even(F.max(depth) * 100, 2).alias("max_drawdown_pct"))


def penalised(row: DataFrame, min_n: float = 15.0) -> DataFrame:
    """Objective columns: too few effective trades or no ratio count as -10 with a drawdown of 100."""
    bad = (F.coalesce("kish_n", F.lit(0.0)) < min_n) | F.col("w_sharpe_like").isNull()
    return row.withColumn("objective", F.when(bad, -10.0).otherwise(F.col("w_sharpe_like"))).withColumn("drawdown", F.when(bad, 100.0).otherwise(F.col("max_drawdown_pct")))


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Summaries of all, actionable, confirmed, research and loosened research outcomes; no tier means actionable."""
    tier = F.coalesce("tier", F.lit("actionable"))
    groups = F.array(F.lit("all"), tier, F.when(F.coalesce("confirmed_filled", F.lit(False)), "confirmed"))
    return summary(outcomes.withColumn("report", F.explode(F.array_compact(groups))), ["report"])


def signal_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("strategy", "signal").agg(F.count("*").alias("n"), F.count_if("catalyst_warning").alias("catalyst_warnings"))


def settlement_counts(settled: DataFrame, signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals by settlement outcome; PENDING_NO_DATA where a ticker has no bar after the signal."""
    newest = bars.groupBy("ticker").agg(F.max("bar_date").alias("newest"))
    df = signals.select("ticker", "signal_date", "strategy").join(newest, "ticker", "left").join(settled.select("ticker", "signal_date", "strategy", "status"), ["ticker", "signal_date", "strategy"], "left")
    outcome = F.when(F.col("newest").isNull() | (F.col("newest") <= F.col("signal_date")), "PENDING_NO_DATA").otherwise(F.coalesce("status", F.lit("ERROR")))
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def progress(outcomes: DataFrame, strategy: str, today) -> DataFrame:
    """Count, win rate and days since the first exit of one strategy."""
    return outcomes.where(F.col("strategy") == strategy).agg(F.count("*").alias("n"), (F.try_divide(F.count_if(F.col("status") == "WIN"), F.count("*")) * 100).alias("win_rate_pct"), F.datediff(F.lit(today).cast("date"), F.min("exit_date")).alias("days_running"))


def universe_delta(summaries: DataFrame, a: str, b: str) -> DataFrame:
    """Win rate and ratio of universe a less those of b; no ratio counts as 0."""
    pick = lambda u, c: F.max(F.when(F.col("universe_id") == u, F.col(c)))
    ratio = lambda u: F.coalesce(pick(u, "sharpe_like"), F.lit(0.0))
    return summaries.agg((pick(a, "win_rate_pct") - pick(b, "win_rate_pct")).alias("win_rate_delta"), (ratio(a) - ratio(b)).alias("sharpe_delta"))
