"""Price-bar tables: scans, trims and the adapter from order lines.

A bars table has ticker, bar_date, open, high, low, close, volume (and sector where known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: The calendar year of bars that are partitioned by ticker and year.
YEAR = "bar_year"
BAR = ["open", "high", "low", "close", "volume"]
#: Calendar days of history read before a test window, for indicators to warm up.
WARM_UP_DAYS = 420


def bars_from_lines(lines: DataFrame, key: list[str], bar_date: str) -> DataFrame:
    """One bar for each key and date: first, highest, lowest and last price in a fixed order, and summed quantity."""
    price = F.col("l_extendedprice").cast("double")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.groupBy(*key, F.col(bar_date).alias("bar_date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(F.col("l_quantity").cast("double")).alias("volume"),
    )


def bar_parts(lines: DataFrame, key: list[str], bar_date: str) -> DataFrame:
    """Bars with the places of their first and last price in the order, so that bars of several keys can be put together."""
    price = F.col("l_extendedprice").cast("double")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.groupBy(*key, F.col(bar_date).alias("bar_date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(F.col("l_quantity").cast("double")).alias("volume"), F.min(order).alias("first"), F.max(order).alias("last"),
    )


def merged_bars(parts: DataFrame, key: list[str]) -> DataFrame:
    """Bars of a coarser key from parts."""
    return parts.groupBy(*key, "bar_date").agg(F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"))


def panel(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(weekly bars, market bars) of one scan of the lines, kept in the shared folder for all branches of a job.

    The index is put together from bars by nation; lines whose supplier has no nation are a part without one.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    parts = kept(bar_parts(_lines(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left"), ["s_nationkey"], "week"))
    bars = parts.join(universe(spark, sf_dir).withColumnRenamed("nation_key", "s_nationkey"), "s_nationkey").select("ticker", "sector", "bar_date", *BAR)
    return bars, merged_bars(parts, [])


def _lines(spark, sf_dir: str) -> DataFrame:
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*cols)
    return lines.withColumn("week", F.to_date(F.date_trunc("week", "l_shipdate")))


def weekly_bars(spark, sf_dir: str) -> DataFrame:
    """Weekly bars by nation of the supplier, with its region as sector.

    Supplier is joined before the sums (it gives the key); the two smaller tables
    after, on one row for each nation.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    lines = _lines(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return bars_from_lines(lines, ["s_nationkey"], "week").join(universe(spark, sf_dir).withColumnRenamed("nation_key", "s_nationkey"), "s_nationkey").select("ticker", "sector", "bar_date", *BAR)


def universe(spark, sf_dir: str) -> DataFrame:
    """(nation_key, ticker, sector): nations and their regions."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))


def market_bars(spark, sf_dir: str) -> DataFrame:
    """The market index: weekly bars of all lines together."""
    return bars_from_lines(_lines(spark, sf_dir), [], "week")


def daily_supplier_bars(spark, sf_dir: str) -> DataFrame:
    """A larger universe: daily bars by supplier."""
    return bars_from_lines(_lines(spark, sf_dir), ["l_suppkey"], "l_shipdate").withColumn("ticker", F.col("l_suppkey").cast("string"))


def daily_supplier_bars_by_year(spark, sf_dir: str) -> DataFrame:
    """Daily bars by supplier with `bar_year`, partitioned by ticker and year.

    A supplier has hardly more than one line a day, so the lines are sent as they are, narrower than parts of
    bars would be; bars are made where they arrive.
    """
    ticker, year = F.col("l_suppkey").cast("string"), F.year("l_shipdate")
    lines = _lines(spark, sf_dir).drop("week").repartition(ticker, year).withColumns({"ticker": ticker, "bar_day": F.to_date("l_shipdate"), YEAR: year})
    return bars_from_lines(lines, ["ticker", YEAR], "bar_day")


def trailing_year(bars: DataFrame, as_of) -> DataFrame:
    """Bars of the year up to a date."""
    return bars.where((F.col("bar_date") >= F.add_months(F.lit(as_of).cast("date"), -12)) & (F.col("bar_date") <= F.lit(as_of).cast("date")))


def history(bars: DataFrame, start, end, warm_up: int = WARM_UP_DAYS) -> DataFrame:
    """Bars from `warm_up` days before start up to, not with, end; the filter reaches the scan."""
    return bars.where((F.col("bar_date") >= F.date_sub(F.lit(start).cast("date"), warm_up)) & (F.col("bar_date") < F.lit(end).cast("date")))


def trim_trailing(bars: DataFrame) -> DataFrame:
    """Without a ticker's last bars as long as they have no close; gaps inside stay."""
    last = F.max(F.when(F.col("close").isNotNull(), F.col("bar_date"))).over(Window.partitionBy("ticker"))
    return bars.withColumn("__last", last).where("bar_date <= __last").drop("__last")
