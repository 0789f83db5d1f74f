"""Readers of the small inputs: watchlists, ticker lists, holdings, memberships, headlines, earnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_ticker(x: Column) -> Column:
    return F.upper(F.trim(x))


ENTRY = "STRUCT<ticker STRING, sector STRING, strategy STRING>"


def watchlist(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """(other columns, pos, ticker, sector, strategy) of whole watchlist texts, entries in order.

    A text that starts as JSON is an array or {"watchlist": [...]} of strings or entries; if
    it is malformed or names no ticker, and for any other text, each line is a ticker.
    Blank tickers are dropped, repeated ones kept.
    """
    t = F.col(text_col)
    body = F.when(F.substring(F.trim(t), 1, 1) == "[", t).otherwise(F.get_json_object(t, "$.watchlist"))
    is_json = F.regexp_extract(t, r"^\s*([\[{])", 1) != ""

    def entry(item: Column) -> Column:
        e = F.from_json(item, ENTRY)
        is_object = F.substring(F.trim(item), 1, 1) == "{"
        return F.struct(clean_ticker(F.when(is_object, e["ticker"]).otherwise(item)).alias("ticker"), F.when(is_object, e["sector"]).alias("sector"), F.when(is_object, e["strategy"]).alias("strategy"))

    named = lambda e: F.coalesce(e["ticker"] != "", F.lit(False))
    # Strings come as themselves, objects as their JSON text.
    entries = F.filter(F.transform(F.from_json(body, "ARRAY<STRING>"), entry), named)
    none = F.lit(None).cast("string")
    lines = F.filter(F.transform(F.split(t, "\r\n|\r|\n"), lambda x: F.struct(clean_ticker(x).alias("ticker"), none.alias("sector"), none.alias("strategy"))), named)
    others = [c for c in texts.columns if c != text_col]
    rows = texts.select(*others, F.when(is_json & (F.size(entries) > 0), entries).otherwise(lines).alias("e"))
    return rows.select(*others, F.posexplode("e").alias("pos", "e")).select(*others, "pos", "e.*")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    return watchlist(spark.read.text(path, wholetext=True))


def sector_map(entries: DataFrame) -> DataFrame:
    """(ticker, sector): a ticker's last entry (by pos) with a sector counts, without the white space around it."""
    return entries.where("sector <> ''").groupBy("ticker").agg(F.trim(F.max_by("sector", "pos")).alias("sector"))


def ticker_list(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """(pos, ticker) of free-form lists split at commas and white space; the first of equal ones stays."""
    items = texts.select(F.posexplode(F.split(clean_ticker(F.col(text_col)), r"[\s,]+")).alias("pos", "ticker")).where("ticker <> ''")
    return items.groupBy("ticker").agg(F.min("pos").alias("pos")).select("pos", "ticker")


def holdings_text(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """(ticker, amount, avg_cost) from lines of ticker, amount and maybe cost, split at commas or white space.

    Lines of another form or with an amount that is no positive number are skipped, an unreadable cost
    is null, and a ticker's last line wins.
    """
    lines = texts.select(F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.select("pos", F.filter(F.split("line", r"[,\s]+"), lambda x: x != "").alias("f"))
    lines = lines.select("pos", F.upper(F.get("f", F.lit(0))).alias("ticker"), F.expr("try_cast(get(f, 1) AS DOUBLE)").alias("amount"), F.expr("try_cast(get(f, 2) AS DOUBLE)").alias("avg_cost"), F.size("f").alias("n"))
    good = lines.where("n BETWEEN 2 AND 3 AND amount > 0")
    return good.groupBy("ticker").agg(F.max_by(F.struct("amount", "avg_cost"), "pos").alias("h")).select("ticker", "h.amount", "h.avg_cost")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_date, tickers) from a CSV with comma-joined tickers."""
    rows = spark.read.csv(path, header=True, schema="date STRING, tickers STRING")
    return rows.select(F.to_date("date").alias("snapshot_date"), F.split("tickers", ",").alias("tickers"))


def members_as_of(membership: DataFrame, day) -> DataFrame:
    """Tickers of the last snapshot up to `day`, or of the earliest one."""
    day = F.lit(day).cast("date")
    past = F.when(F.col("snapshot_date") <= day, F.col("snapshot_date"))
    pick = membership.agg(F.coalesce(F.max_by("tickers", past), F.min_by("tickers", "snapshot_date")).alias("tickers"))
    return pick.select(F.explode("tickers").alias("ticker"))


def membership_spells(membership: DataFrame) -> DataFrame:
    """(ticker, member_from, member_until): a row for each run of snapshots that hold a ticker, until the first that does not.

    What the first snapshot holds was there before it (member_from is null), what the last one
    holds stays (member_until is null).  Snapshots of one day are one.
    """
    days = membership.select("snapshot_date").distinct()
    w = Window.orderBy("snapshot_date")  # a row for each snapshot
    days = days.select("snapshot_date", F.row_number().over(w).alias("k"), F.lead("snapshot_date").over(w).alias("following"))
    held = membership.join(days, "snapshot_date").select("k", "snapshot_date", "following", F.explode("tickers").alias("ticker")).distinct()
    held = held.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("ticker").orderBy("k")))
    spells = held.groupBy("ticker", "run").agg(F.min("k").alias("k"), F.min("snapshot_date").alias("a"), F.max_by("following", "k").alias("member_until"))
    return spells.select("ticker", F.when(F.col("k") > 1, F.col("a")).alias("member_from"), "member_until")


def headlines(items: DataFrame, count: int = 3) -> DataFrame:
    """(ticker, rank, title) of the first `count` items; an item without a title uses up its place."""
    first = items.where(F.col("rank") <= count)
    title = F.coalesce(F.nullif("item.content.title", F.lit("")), F.col("item.title"))
    return first.select("ticker", "rank", title.alias("title")).where("coalesce(title, '') <> ''")


def top_headline(items: DataFrame) -> DataFrame:
    """(ticker, top_headline): the first title, or an empty string."""
    titles = headlines(items)
    return items.select("ticker").distinct().join(titles.groupBy("ticker").agg(F.min_by("title", "rank").alias("t")), "ticker", "left").select("ticker", F.coalesce("t", F.lit("")).alias("top_headline"))


def earnings_calendar(earnings: DataFrame, limit: int | None = None) -> DataFrame:
    """(ticker, earnings_ts), the newest `limit` for each ticker; other columns are not read."""
    out = earnings.select("ticker", "earnings_ts")
    if limit is None:
        return out
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("earnings_ts")))
    return out.withColumn("__n", newest).where(F.col("__n") <= limit).drop("__n")
