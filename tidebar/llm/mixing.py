"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source is a queue of its shuffled documents, repeated once.  A document's
virtual finish time is the words of its source up to and with it, divided by the
source's weight: all sources are then served in proportion to their weights, and a
source that has no more documents leaves its share to the others.  Documents are
taken in order of finish time until the total budget is reached.

Running sums never put a source into one task: documents are dealt to buckets by a
hash (within a source) or by range (of finish times), sums of buckets give each
bucket its start, and only what is inside a bucket is summed in order.  The number of
buckets grows with the table; the range in which the budget ends is cut into ranges
again until it is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: Rows of a bucket of shuffled documents on average; ranges of finish times in one step, and services that one task sorts.
BUCKET_ROWS, RANGES, SORTED = 4096, 4096, 1_000_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], budget_share: float, most: float) -> DataFrame:
    """(no_source, source, total) with weight, cap, target added: one row for each source.

    Sources by code point, nulls last, weigh `weights` in turn.  Targets are
    min(cap, level * weight) with one level for all: it is what handing the excess
    over caps to the other sources by weight ends in.  Sorted by cap / weight, the
    level is that of the first source that its level does not fill: those before it are
    full, it and those after it share what is left.
    """
    rank = F.expr("row_number() OVER (ORDER BY no_source, source) - 1")
    out = sizes.select("no_source", "source", "total", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")).cast("double").alias("weight"))
    out = out.withColumn("cap", F.col("total") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    order = "ORDER BY fill, no_source, source"
    out = out.select("*", F.expr("sum(total) OVER ()").alias("all"), F.expr(f"coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)").alias("before"), F.expr(f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").alias("rest"))
    budget = F.least(F.col("all") * F.lit(float(budget_share)), F.col("all") * F.lit(float(most)))
    level = (budget - F.col("before")) / F.col("rest")
    out = out.withColumn("first", F.when(level <= F.col("fill"), F.struct("fill", "no_source", "source", level.alias("level"))))
    out = out.withColumn("level", F.expr("min(first) OVER ()")["level"])
    return out.select("no_source", "source", "total", "weight", "all", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def queued(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (source, size, h, bucket, ...) with total, target, weight and end: the source's words up to and with the row.

    The window and the join share one exchange by (source, bucket).
    """
    inside = F.expr("sum(size) OVER (PARTITION BY no_source, source, bucket ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    out = rows.withColumn("inside", inside).join(starts.hint("merge"), ["no_source", "source", "bucket"])
    return out.withColumn("end", F.col("start") + F.col("inside")).drop("start", "inside")


def finish(k: int) -> Column:
    """The virtual finish time of a row's service in pass k."""
    return (F.col("end") + F.col("total") * k) / F.col("weight")


def last_served(rows: DataFrame, budget: float, most: int) -> tuple[float, str] | None:
    """(finish time, h) of the last service within the budget, in the global order of (finish time, h).

    Ranges of finish times are summed; the one in which the budget ends is cut into
    ranges again while it is large, and only what is left is sorted.  The last service
    counts if at least half of it is within.
    """
    items = rows.select(F.explode(F.array(*(F.struct(finish(k).alias("v"), "h", "size") for k in range(most)))).alias("i")).select("i.*")
    low, high, done = 0.0, items.agg(F.max("v")).first()[0], 0
    if not high:
        return None
    while True:
        at = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * RANGES)
        sums = items.groupBy(at.alias("range")).agg(F.sum("size").alias("words"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        sums = sums.select("*", (F.expr("sum(words) OVER (ORDER BY range)") + done).alias("upto"))
        cut = sums.where(F.col("upto") >= F.lit(budget)).orderBy("range").first()
        items, done = items.where(F.col("v").between(cut["low"], cut["high"])), cut["upto"] - cut["words"]
        low, high = cut["low"], cut["high"]
        if cut["n"] <= SORTED or low == high:
            break
    inside = items.withColumn("upto", F.expr("sum(size) OVER (ORDER BY v, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") + done)
    last = inside.where(F.col("upto") - F.col("size") / 2 <= F.lit(budget)).agg(F.max(F.struct("v", "h")).alias("m")).first()["m"]
    return (last["v"], last["h"]) if last else (low, "")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget_share: float = 1.5, most: int = 2, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with size, source_size, target, copies, taken added.

    size is the number of words (null text: 0), source_size that of the row's source
    (nulls are one source).  copies (0 to `most`) is how often the row is in the mix
    and taken = copies * size.  Documents of a source are shuffled by an md5 of seed,
    id and text, so rows without id are shuffled as well; rows that repeat both follow
    each other.  A source is off its target by the length of a document or so.  Empty texts cost nothing and are taken with the
    documents before them; a table without any word has no mix.  `columns` are those
    to keep (all); columns that have a name of an added column are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in (columns or docs.columns) if c.lower() not in added]
    names = {f"c{i}": c for i, c in enumerate(keep)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for n, c in names.items())).alias("row"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), n_words(text).alias("size"), h.alias("h"))
    # Buckets follow the order of h: its first bits, more of them for a larger table.
    bits = max(8, math.ceil(math.log2(max(1, docs.count()) / BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits))
    thin = written(rows.select("no_source", "source", "size", "h", "bucket"))
    by_bucket = written(thin.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("words")))
    targets = written(source_targets(by_bucket.groupBy("no_source", "source").agg(F.sum("words").alias("total")), list(weights), budget_share, most))
    starts = by_bucket.select("no_source", "source", "bucket", (F.expr("sum(words) OVER (PARTITION BY no_source, source ORDER BY bucket)") - F.col("words")).alias("start"))
    starts = written(starts.join(targets.select("no_source", "source", "total", "target", "weight"), ["no_source", "source"]))
    budget = (targets.agg(F.max("all")).first()[0] or 0) * min(budget_share, most)
    last = last_served(queued(thin, starts), budget, most)
    rows = queued(rows, starts)
    served = [F.when(F.struct(finish(k).alias("v"), F.col("h").alias("h")) <= F.struct(F.lit(last[0]).alias("v"), F.lit(last[1]).alias("h")), 1).otherwise(0) if last else F.lit(0) for k in range(most)]
    out = rows.select("row", "size", F.col("total").alias("source_size"), "target", sum(served[1:], served[0]).cast("int").alias("copies"))
    return out.select(*(F.col(f"row.{n}").alias(c) for n, c in names.items()), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
