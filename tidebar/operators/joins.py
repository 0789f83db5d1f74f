"""As-of joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_ticker, sma


def asof_calendar(left: DataFrame, right: DataFrame, columns: list[str], day: str = "bar_date") -> DataFrame:
    """Left rows with `columns` of the last row of `right` up to their day; right has one row for each day of one calendar.

    Each row of the calendar is laid out over the days up to the next one, so the join is an
    equality with a side of one narrow row for each day of one calendar, whatever the
    number of tickers.  The last row holds on without an end (a scalar subquery).  No
    earlier row gives nulls.
    """
    following = F.lead(day).over(Window.orderBy(day))
    spans = right.select(day, *columns, following.alias("__next"))
    until = F.coalesce(F.date_sub("__next", 1), F.col(day))
    repeated = F.when(F.col("__next") == F.col(day), F.raise_error(F.lit("repeated day in the calendar")).cast("date")).otherwise(until)
    days = spans.select(F.explode(F.sequence(F.col(day), repeated)).alias(day), *columns)
    last = right.agg(F.max_by(F.struct(F.col(day).alias("__day"), *columns), day)).scalar()
    out = left.join(F.broadcast(days), day, "left").withColumn("__last", last)
    return out.withColumns({c: F.when(F.col(day) > F.col("__last.__day"), F.col(f"__last.{c}")).otherwise(F.col(c)) for c in columns}).drop("__last")


def members_then(rows: DataFrame, spells: DataFrame, day: str) -> DataFrame:
    """Rows whose ticker was a member on their day; a ticker has a spell or a few, which do not overlap."""
    s = spells.select(F.col("ticker").alias("__t"), "member_from", "member_until")
    inside = (F.col("member_from").isNull() | (F.col("member_from") <= F.col(day))) & (F.col("member_until").isNull() | (F.col(day) < F.col("member_until")))
    return rows.join(s, (F.col("ticker") == F.col("__t")) & inside, "left_semi")


def market_is_up(market: DataFrame, trend: int) -> DataFrame:
    """(bar_date, market_up) of the index's last bar; an error where its average has too few bars."""
    last = market.withColumn("ticker", F.lit("")).withColumn("sma_trend", sma("close", trend)).groupBy("ticker").agg(F.max_by(F.struct("bar_date", "close", "sma_trend"), "bar_date").alias("b")).select("b.*")
    up = F.when(F.col("sma_trend").isNull(), F.raise_error(F.lit("the market index has too short a history")).cast("boolean")).otherwise(F.col("close") >= F.col("sma_trend"))
    return last.select("bar_date", up.alias("market_up"))


def market_uptrend(bars: DataFrame, market: DataFrame, trend: int) -> DataFrame:
    """Bars with `market_up`: whether the index closed at or above its average on its last bar up to the date."""
    index = market.withColumn("ticker", F.lit("")).withColumn("sma_trend", sma("close", trend)).select("bar_date", (F.col("close") >= F.col("sma_trend")).alias("market_up"))
    return asof_calendar(bars, index, ["market_up"]).withColumn("market_up", F.coalesce("market_up", F.lit(False)))


def next_earnings(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Bars with next_earnings_ts: their ticker's first report at or after midnight of the bar."""
    at = F.col("bar_date").cast("timestamp")
    left = bars.withColumn("__at", at).withColumn("__e", F.lit(None).cast("timestamp"))
    right = earnings.select("ticker", F.col("earnings_ts").alias("__at"), F.col("earnings_ts").alias("__e"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Ascending in descending time; at equal times a report comes before the bar.
    w = Window.partitionBy("ticker").orderBy(F.desc("__at"), F.col("__e").isNull())
    both = both.withColumn("next_earnings_ts", F.last("__e", ignorenulls=True).over(w))
    return both.where("__e IS NULL AND bar_date IS NOT NULL").drop("__at", "__e")


def catalyst_warning(days: int, bar_date: str = "bar_date") -> Column:
    gap = (F.unix_timestamp("next_earnings_ts") - F.unix_timestamp(F.col(bar_date).cast("timestamp"))) / 86400
    return F.coalesce(gap <= days, F.lit(False))


def bars_after(signals: DataFrame, bars: DataFrame, count) -> DataFrame:
    """Each signal (ticker, signal_date, ...) with its next `count` bars: k from 1, and `bar`, the bar's columns.

    Bars are numbered by ticker; a signal finds the number of its last bar by an as-of
    window and meets only the `count` bars after it, by equality of ticker and number.
    `count` is a number or a column of the signals.  Where there are fewer bars, `bar` is null.
    """
    count = count if isinstance(count, Column) else F.lit(count)
    columns = [c for c in bars.columns if c != "ticker"]
    numbered = bars.select("ticker", *columns, F.row_number().over(by_ticker()).alias("rn"))
    ask = signals.select("ticker", F.to_date("signal_date").alias("bar_date"), F.lit(None).cast("int").alias("rn"), F.struct(*signals.columns).alias("s"))
    known = numbered.select("ticker", "bar_date", "rn", F.lit(None).cast(ask.schema["s"].dataType).alias("s"))
    # At equal dates the bar comes first: it is not later than the signal.
    order = Window.partitionBy("ticker").orderBy("bar_date", F.col("s").isNotNull())
    start = known.union(ask).withColumn("rn0", F.coalesce(F.last("rn", ignorenulls=True).over(order), F.lit(0))).where("s IS NOT NULL").select("s.*", "rn0")
    steps = start.withColumn("k", F.explode_outer(F.when(count >= 1, F.sequence(F.lit(1), count))))
    bar = numbered.select("ticker", F.col("rn").alias("rn1"), F.struct(*columns).alias("bar"))
    return steps.withColumn("rn1", F.col("rn0") + F.col("k")).join(bar, ["ticker", "rn1"], "left").select(*signals.columns, "k", "bar")


def with_sector(rows: DataFrame, sectors: DataFrame, default: str | None = "Unknown") -> DataFrame:
    """Rows with their ticker's sector; the dimension's rows are left to Spark's own size check for broadcasting."""
    out = rows.drop("sector").join(sectors.select("ticker", "sector"), "ticker", "left")
    return out.withColumn("sector", F.coalesce("sector", F.lit(default).cast("string")))


def assign_folds(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, sample, trade) for each window that holds the trade's signal date.

    Windows are laid out by day: an equality join with one narrow row for each fold and day.
    """
    window = lambda name, a, z: F.struct(F.lit(name).alias("sample"), F.sequence(F.col(a), F.date_sub(z, 1)).alias("days"))
    windows = folds.select("fold_id", "oos_end", F.explode(F.array(window("is", "is_start", "is_end"), window("oos", "oos_start", "oos_end"))).alias("w"))
    days = windows.select("fold_id", "w.sample", "oos_end", F.explode("w.days").alias("signal_date"))
    return trades.join(F.broadcast(days), "signal_date").select("fold_id", "sample", "oos_end", *trades.columns)


def sector_breakdown(holdings: DataFrame, spends: DataFrame) -> DataFrame:
    """(sector, held, new_spend, total): full outer join of two sums by sector."""
    a = holdings.groupBy("sector").agg(F.sum("amount").alias("held"))
    b = spends.groupBy("sector").agg(F.sum("est_cost").alias("new_spend"))
    out = a.join(b, "sector", "full").select("sector", F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("new_spend", F.lit(0.0)).alias("new_spend"))
    return out.withColumn("total", F.col("held") + F.col("new_spend"))


def merge_candidates(scored: DataFrame) -> DataFrame:
    """One row for each ticker: a map from strategy to score, and the best score."""
    out = scored.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("strategy", "trade_score")))).alias("scores"), F.max("trade_score").alias("best"))
    return out.orderBy(F.desc("best"), "ticker")
