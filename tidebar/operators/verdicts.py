"""Prompt texts and checked model verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import StrategyConfig
from ..functions.numeric import reward_risk, round_even

DECISIONS = ("Buy", "Hold", "Avoid")


def parsed_verdicts(responses: DataFrame) -> DataFrame:
    """(ticker, decision, confidence, rationale) of valid JSON bodies: a known decision, confidence 0 to 100, some rationale."""
    j = F.from_json("body", "decision STRING, confidence STRING, rationale STRING", {"mode": "PERMISSIVE"})
    df = responses.select("ticker", j.alias("j")).select("ticker", "j.decision", F.expr("try_cast(j.confidence AS DOUBLE)").alias("confidence"), "j.rationale")
    return df.where(F.col("decision").isin(*DECISIONS) & F.col("confidence").between(0, 100) & (F.trim("rationale") != "")).withColumn("rationale", F.trim("rationale"))


def verdict_levels(verdicts: DataFrame, latest: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """Levels rows of Buy and Hold verdicts (Hold is Watch): a bracket around the last close, the confidence as score."""
    df = verdicts.where(F.col("decision").isin("Buy", "Hold")).join(latest.where("atr IS NOT NULL").select("ticker", "bar_date", "close", "atr"), "ticker")
    buy = round_even(F.col("close"), 2)
    df = df.withColumn("buy_price", buy).withColumn("sell_price", round_even(buy + F.col("atr") * cfg.tp_mult, 2)).withColumn("stop_loss", round_even(buy - F.col("atr") * cfg.sl_mult, 2))
    return df.select("ticker", F.col("bar_date").alias("as_of"), F.lit("llm_agent").alias("strategy"), F.when(F.col("decision") == "Buy", "Buy").otherwise("Watch").alias("signal"), F.col("confidence").alias("trade_score"), round_even(F.col("atr"), 2).alias("atr"), "buy_price", "sell_price", "stop_loss", reward_risk(F.col("buy_price"), F.col("sell_price"), F.col("stop_loss")).alias("rrr"))


ANSWER = 'Answer with one JSON object: {"decision": "Buy", "Hold" or "Avoid", "confidence": a number from 0 to 100, "rationale": two or three sentences}.'


def _listed(m: Column, shown: Callable[[Column], Column], none: str) -> Column:
    """Entries of a map as `key=value`, in the order of keys."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"])))
    return F.when(F.size(entries) > 0, F.array_join(entries, ", ")).otherwise(F.lit(none))


def prompts(rows: DataFrame, headlines: DataFrame, count: int = 5) -> DataFrame:
    """(ticker, prompt, n_headlines): a candidate's readings, scores by strategy, reports, fundamentals and up to `count` headlines as text.

    Rows have ticker, last_close, rsi, atr, catalyst_warning, next_earnings_date, scores (strategy to
    score) and fundamentals (name to text); what is null reads as unknown.
    """
    titles = headlines.where((F.col("rank") <= count) & (F.coalesce("title", F.lit("")) != "")).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("rank", "title")))["title"].alias("t"))
    df = rows.join(titles, "ticker", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    number = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("unknown"))
    text = F.concat(
        F.lit("Ticker "), "ticker", F.lit(": last close "), number("last_close"), F.lit(", RSI "), number("rsi"), F.lit(", ATR "), number("atr"),
        F.lit(". Scores by strategy: "), _listed(F.col("scores"), lambda v: F.format_string("%.1f", v), "none"), F.lit(". Report within the warning window: "), F.when(F.coalesce("catalyst_warning", F.lit(False)), "yes").otherwise("no"),
        F.lit("; next report: "), F.coalesce(F.date_format("next_earnings_date", "yyyy-MM-dd"), F.lit("unknown")), F.lit(". Fundamentals: "), _listed(F.col("fundamentals"), lambda v: v, "none"),
        F.lit(".\nHeadlines ("), F.size("t").cast("string"), F.lit("):\n"), F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("none"), F.lit("\n" + ANSWER),
    )
    return df.select("ticker", text.alias("prompt"), F.size("t").alias("n_headlines"))
