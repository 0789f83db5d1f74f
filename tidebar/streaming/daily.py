"""The daily upsert as a stream: each micro-batch of scored rows goes through the same keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import tiered
from ..sources.versions import upsert_months


def upsert_stream(scored_rows: DataFrame, table_path: str, checkpoint: str, now: str) -> StreamingQuery:
    """Writes a stream of scored rows into the signals table; a repeated batch changes nothing but the time stamp.

    A batch rewrites the months of its signals only.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = tiered(rows)
        if not new.isEmpty():
            upsert_months(new, table_path, now)

    return scored_rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
