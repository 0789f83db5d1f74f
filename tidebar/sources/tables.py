"""Keyed tables of signals, outcomes, configurations and holdings: pure functions from old rows to new ones, and a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ticker", "signal_date", "strategy"]
#: Columns that a new scan never overwrites, and those that it sets anew.
CONFIRMATION = ["confirmed_filled", "fill_price", "confirmed_at"]
LOGGED = ("Strong Buy", "Buy", "Watch")


def native(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def signal_rows(rows: DataFrame, config_json: str, now) -> DataFrame:
    """Scored rows as stored signals: dates as ISO text, NaN as null, the configuration as JSON."""
    numbers = [c for c, t in rows.dtypes if t == "double"]
    rows = rows.select(*(native(F.col(c)).alias(c) if c in numbers else F.col(c) for c in rows.columns))
    return rows.withColumn("signal_date", F.date_format("as_of", "yyyy-MM-dd")).drop("as_of").withColumn("config_snapshot", F.lit(config_json)).withColumn("settled", F.lit(False)).withColumn("now", F.lit(now).cast("timestamp"))


def tiered(rows: DataFrame, forced: str | None = None) -> DataFrame:
    """Loggable rows with their tier: Strong Buy and Buy are actionable, Watch is research."""
    tier = F.lit(forced) if forced else F.when(F.col("signal").isin("Strong Buy", "Buy"), "actionable").otherwise("research")
    return rows.where(F.col("signal").isin(*LOGGED)).withColumn("tier", tier)


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, keep_old: list[str] = CONFIRMATION, insert_only: str = "created_at", stamp: str = "updated_at", now=None) -> DataFrame:
    """Old rows with new ones by key.

    New values win, except for `keep_old` and for `insert_only`, which is set when
    the key is new.  Of repeated new keys the last by all columns counts; a null in a key
    equals a null.  One full outer join; write the result over the partitions it touches.
    """
    values = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*values)).alias("__v")) if values else new.distinct().withColumn("__v", F.struct(F.lit(1)))
    one = one.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), "__v", F.lit(True).alias("__new"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & old[k].eqNullSafe(one[f"__k{i}"])
    both = old.join(one, same, "full")
    columns = []
    stamp_now = F.lit(now).cast("timestamp")
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c in key:
            columns.append(F.coalesce(F.col(c), F.col(f"__k{key.index(c)}")).alias(c))
        elif c == insert_only:
            columns.append(F.coalesce(F.col(c), stamp_now).alias(c))
        elif c == stamp:
            columns.append(F.when(F.col("__new"), stamp_now).otherwise(F.col(c)).alias(c))
        elif c in keep_old or c not in values:
            columns.append(F.col(c) if c in old.columns else F.col(f"__v.{c}").alias(c))
        elif c in old.columns:
            columns.append(F.when(F.col("__new"), F.col(f"__v.{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"__v.{c}").alias(c))
    return both.select(*columns)


def log_signals(old: DataFrame, rows: DataFrame, now, forced_tier: str | None = None) -> DataFrame:
    return upsert(old, tiered(rows, forced_tier), now=now)


def tier_counts(rows: DataFrame, forced_tier: str | None = None) -> DataFrame:
    return tiered(rows, forced_tier).groupBy("tier").agg(F.count("*").alias("n"))


def upsert_outcomes(old: DataFrame, settled: DataFrame, now) -> DataFrame:
    """Terminal results by key; open ones are not stored."""
    return upsert(old, settled.where("status <> 'OPEN'"), keep_old=[], stamp="settled_at", now=now)


def mark_settled(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    done = outcomes.select(*KEY).distinct().withColumn("__done", F.lit(True))
    return signals.join(done, KEY, "left").withColumn("settled", F.coalesce("__done", "settled")).drop("__done")


def confirm(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Signals after the events (confirmed, fill_price, at) of their keys in order of time.

    A confirmation sets flag and time, and the price if it has one; an undone one sets
    the flag to false and clears price and time.  So the price is the last one given since
    the last undoing, or the signal's own if there was none.
    """
    undone = F.max(F.when(~F.col("confirmed"), F.col("at"))).over(Window.partitionBy(*KEY))
    e = events.withColumn("__undone", undone)
    since = (F.col("__undone").isNull() | (F.col("at") > F.col("__undone"))) & F.col("confirmed") & F.col("fill_price").isNotNull()
    last = e.groupBy(*KEY).agg(F.max_by(F.struct("confirmed", "at"), F.struct("at", ~F.col("confirmed"))).alias("__e"), F.max_by("fill_price", F.when(since, F.col("at"))).alias("__price"), F.max("__undone").alias("__undone"))
    df = signals.join(last, KEY, "left")
    seen, yes = F.col("__e").isNotNull(), F.col("__e.confirmed")
    price = F.coalesce("__price", F.when(F.col("__undone").isNull(), F.col("fill_price")))
    return df.select(
        *(c for c in signals.columns if c not in CONFIRMATION),
        F.when(seen, yes).otherwise(F.col("confirmed_filled")).alias("confirmed_filled"),
        F.when(seen, F.when(yes, price)).otherwise(F.col("fill_price")).alias("fill_price"),
        F.when(seen, F.when(yes, F.col("__e.at"))).otherwise(F.col("confirmed_at")).alias("confirmed_at"),
    )


def pending_confirmation(signals: DataFrame) -> DataFrame:
    """Actionable signals not yet confirmed, newest first."""
    df = signals.where("coalesce(tier, 'actionable') = 'actionable' AND NOT coalesce(confirmed_filled, false)")
    return df.orderBy(F.desc("signal_date"), "ticker", "strategy")


def unsettled(signals: DataFrame) -> DataFrame:
    return signals.where("NOT coalesce(settled, false)").withColumn("strategy", F.coalesce("strategy", F.lit("rsi"))).withColumn("tier", F.coalesce("tier", F.lit("actionable")))


def add_candidate(configs: DataFrame, params_json: str, metrics: dict[str, float], notes: str, now) -> DataFrame:
    """Configurations with a new candidate, one version up."""
    m = F.create_map(*(F.lit(x) for kv in sorted(metrics.items()) for x in kv)) if metrics else F.lit(None)
    new = configs.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).select("version", F.lit("candidate").alias("status"), F.lit(params_json).alias("params"), m.cast("map<string,double>").alias("metrics"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("promoted_at"), F.lit(notes).alias("notes"))
    return configs.unionByName(new)


def promote(configs: DataFrame, version: int, now) -> DataFrame:
    """The chosen version becomes active, the active one retires; a missing version is an error when the rows are read."""
    found = configs.agg(F.count_if(F.col("version") == version).alias("__found"))
    df = configs.join(F.broadcast(found))  # one row
    status = F.when(F.col("version") == version, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status"))
    checked = F.when(F.col("__found") == 0, F.raise_error(F.lit(f"no configuration with version {version}")).cast("string")).otherwise(status)
    return df.withColumn("promoted_at", F.when(F.col("version") == version, F.lit(now).cast("timestamp")).otherwise(F.col("promoted_at"))).withColumn("status", checked).drop("__found")


def active_config(configs: DataFrame) -> DataFrame:
    return configs.where("status = 'active'").orderBy(F.desc("version")).limit(1)


def configs_newest_first(configs: DataFrame) -> DataFrame:
    return configs.orderBy(F.desc("version"))


def clean_holdings(rows: DataFrame, now) -> DataFrame:
    return rows.where("amount > 0").select(F.upper(F.trim("ticker")).alias("ticker"), "amount", F.nullif("avg_cost", F.lit(0.0)).alias("avg_cost"), F.lit(now).cast("timestamp").alias("updated_at"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
