"""Sizing and allocation of capital."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.numeric import round_even
from ..sources.shared import kept


def sized(rows: DataFrame, decimals: int = 4, risk: float | None = None, budget: float | None = None) -> DataFrame:
    """Adds shares and est_cost: a fixed loss at the stop, or a fixed spend."""
    if risk is not None:
        per_share = F.col("buy_price") - F.col("stop_loss")
        shares = F.when(per_share > 0, F.try_divide(F.lit(float(risk)), per_share)).otherwise(0.0)
    else:
        shares = F.try_divide(F.lit(float(budget)), F.col("buy_price"))
    df = rows.withColumn("shares", round_even(shares, decimals))
    return df.withColumn("est_cost", round_even(F.col("shares") * F.col("buy_price"), 2))


#: Rows of a pool that are walked at once.
CHUNK = 50_000
#: Types of the state between chunks.
_STATE = "struct<left:double,by:array<struct<sector:string,spent:double>>>"


def _ranked(df: DataFrame, pool: list[str]) -> tuple[DataFrame, int]:
    """Rows with place, their number (from 0) in the order of their pool, without a pool in one task; and the rows of the largest pool.

    Ranges of (pool, order) are numbered inside, after what the ranges before them hold of the pool.
    """
    keys = [*(F.col(c).asc_nulls_first() for c in pool), F.desc("trade_score"), F.col("ticker"), F.col("signal"), F.col("est_cost"), F.col("sector"), F.col("__tie")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*pool, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*pool).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(pool)), F.col("__part").alias("__q"), before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*pool, "__part").orderBy(*keys[len(pool) :]))
    same = F.col("__part") == F.col("__q")
    for i, c in enumerate(pool):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    out = ranged.withColumn("__k", inside).join(starts, same)
    largest = counts.groupBy(*pool).agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 0
    return out.withColumn("place", F.col("__start") + F.col("__k") - 1).drop("__tie", "__part", "__q", "__start", "__k", *(f"__p{i}" for i in range(len(pool)))), largest


def _walk(cash: float, seed: dict[str, float], cap: float | None, row_type: pa.DataType):
    """Walks a chunk of a pool in order from the state that the chunk before left."""

    def run(chunk: pa.Table, state: pa.Table) -> pa.Table:
        if not chunk.num_rows:  # the pool has ended
            return pa.Table.from_pylist([], schema=schema)
        chunk = chunk.sort_by("place")
        before = state.column("state")[0].as_py() if state.num_rows else {"left": cash, "by": [{"sector": k, "spent": v} for k, v in seed.items()]}
        left, by = before["left"], {x["sector"]: x["spent"] for x in before["by"]}
        labels, spents = [], []
        for signal, cost, sector in zip(*(chunk.column(c).to_pylist() for c in ("signal", "est_cost", "sector")), strict=True):
            label, spent = signal, 0.0
            if signal in ("Strong Buy", "Buy"):
                if cost is not None and cost > left:
                    label = "Insufficient Funds"
                elif cost is not None and sector is not None and cap is not None and by.get(sector, 0.0) + cost > cap:
                    label = "Sector Limit Reached"
                elif cost is not None:
                    spent = cost
                    left -= cost
                    if sector is not None:
                        by[sector] = by.get(sector, 0.0) + cost
            labels.append(label)
            spents.append(spent)
        end = {"left": left, "by": [{"sector": k, "spent": v} for k, v in by.items()]}
        pools = chunk.column("pool").combine_chunks()
        rows = pa.table([pools, chunk.column("row").combine_chunks(), pa.array(labels, pa.string()), pa.array(spents, pa.float64()), pa.nulls(len(labels), schema.field("state").type)], schema=schema)
        return pa.concat_tables([rows, pa.table([pools.slice(0, 1), pa.nulls(1, row_type), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.array([end], schema.field("state").type)], schema=schema)])

    state_type = pa.struct([("left", pa.float64()), ("by", pa.list_(pa.struct([("sector", pa.string()), ("spent", pa.float64())])))])
    schema = pa.schema([("pool", pa.string()), ("row", row_type), ("final_signal", pa.string()), ("spent", pa.float64()), ("state", state_type)])
    return run


def allocate(rows: DataFrame, pool: list[str], cash: float, sectors: DataFrame | None = None, cap_share: float | None = None, holdings: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows with final_signal, spent and allocated (the pool's total), walked by falling score (then ticker) within each pool.

    A row that costs more than is left, or that would lift its sector over the cap,
    is relabelled and takes nothing; the walk goes on.  The cap is a share of cash
    and all holdings, and holdings count as spent in their sectors.  Rows that repeat
    are rows of their own; a null in the pool's columns is a pool, a row without a cost takes nothing.

    Every step depends on the one before, so a pool is walked in chunks: all pools' first
    chunks at once, then the second ones from the states (cash left and spent by sector)
    that the first ones left.  A task holds one chunk, and there are as many rounds
    as the largest pool has chunks: one for pools of some thousand rows.
    """
    df = rows
    if sectors is not None:
        df = df.drop("sector").join(sectors.select("ticker", "sector"), "ticker", "left")
    elif "sector" not in df.columns:
        df = df.withColumn("sector", F.lit(None).cast("string"))
    seed: dict[str, float] = {}
    held = 0.0
    if holdings is not None and cap_share:
        own = holdings.join(sectors.select("ticker", "sector"), "ticker", "left") if sectors is not None and "sector" not in holdings.columns else holdings
        sums = {r["sector"]: r["a"] or 0.0 for r in own.groupBy("sector").agg(F.sum("amount").alias("a")).collect()}  # a row for each sector
        held, seed = sum(sums[k] for k in sorted(sums, key=str)), {k: v for k, v in sums.items() if k is not None}
    cap = (float(cash) + held) * float(cap_share) if cap_share and cap_share > 0 else None
    names = df.columns
    ranked, largest = _ranked(df, pool)
    rounds = -(-largest // chunk)
    key = F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(pool))))
    dealt = ranked.select(key.alias("pool"), F.floor(F.col("place") / chunk).cast("int").alias("chunk"), "place", "signal", F.col("est_cost").cast("double").alias("est_cost"), "sector", F.struct(*names).alias("row"))
    if rounds > 1:
        dealt = kept(dealt)
    row_type = to_arrow_type(dealt.schema["row"].dataType)
    out_type = f"pool string, row {dealt.schema['row'].dataType.simpleString()}, final_signal string, spent double, state {_STATE}"
    state = dealt.sparkSession.createDataFrame([], f"pool string, state {_STATE}")
    done, ends = dealt.sparkSession.createDataFrame([], out_type), state
    for c in range(rounds):
        part = kept(dealt.where(F.col("chunk") == c).groupBy("pool").cogroup(state.groupBy("pool")).applyInArrow(_walk(float(cash), seed, cap, row_type), out_type))
        state = part.where("state IS NOT NULL").select("pool", "state")
        done, ends = done.union(part.where("state IS NULL")), ends.union(state)
    total = ends.groupBy("pool").agg((F.lit(float(cash)) - F.min("state.left")).alias("allocated"))  # what is left only falls
    return done.join(total, "pool").select("row.*", "final_signal", "spent", "allocated")
