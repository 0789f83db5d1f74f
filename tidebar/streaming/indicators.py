"""Indicators of a stream of bars: each micro-batch moves the state of the tickers it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import StrategyConfig
from ..operators.incremental import advance, rows_of
from ..sources.shared import exists, remove


def start_from(state: DataFrame, path: str) -> None:
    """Lays down the state that the first micro-batch goes on from."""
    state.write.mode("overwrite").parquet(f"{path}/state/batch=-1")


def indicator_stream(bars: DataFrame, path: str, checkpoint: str, cfg: StrategyConfig) -> StreamingQuery:
    """Writes the indicator rows of each micro-batch under path/rows and the state after it under path/state.

    Both are named by the batch and made from the state of the batch before, so a batch
    that runs again after a failure writes the same; older states are removed.
    """

    def batch(new: DataFrame, k: int) -> None:
        spark: SparkSession = new.sparkSession
        moved = advance(spark.read.parquet(f"{path}/state/batch={k - 1}"), new, cfg)
        whole = f"{path}/state/batch={k}"
        moved.write.mode("overwrite").parquet(whole)
        rows_of(spark.read.parquet(whole)).write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
        if exists(spark, f"{path}/state/batch={k - 2}"):
            remove(spark, f"{path}/state/batch={k - 2}")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
