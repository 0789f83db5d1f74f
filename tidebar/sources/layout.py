"""Bars laid out for the windows: a bucketed table by ticker, sorted by ticker and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of bars in a bucket, about: what one task reads and sorts at most.
BUCKET_BYTES, ROW_BYTES = 256 << 20, 64


def buckets_for(rows: int, least: int = 1) -> int:
    """As many buckets as keep one at BUCKET_BYTES."""
    return max(least, -(-rows * ROW_BYTES // BUCKET_BYTES))


def save_bars(bars: DataFrame, table: str, buckets: int) -> None:
    """Writes bars as a table bucketed by ticker, one sorted file for each bucket.

    Windows by ticker over it need no exchange, and those in order of days no sort; joins with tables
    bucketed alike by ticker need no exchange either.
    """
    one_file = bars.repartition(buckets, "ticker").sortWithinPartitions("ticker", "bar_date")
    one_file.write.mode("overwrite").bucketBy(buckets, "ticker").sortBy("ticker", "bar_date").format("parquet").saveAsTable(table)


def read_bars(spark: SparkSession, table: str) -> DataFrame:
    """The table as bars; with one file a bucket Spark takes its order as given."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)


def append_day(bars: DataFrame, table: str) -> None:
    """Adds new bars to the same buckets: until `save_bars` runs again windows sort, but still exchange nothing."""
    spark = bars.sparkSession
    columns = spark.table(table).columns
    buckets = int(spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(F.col("col_name") == "Num Buckets").first()["data_type"])
    bars.select(*columns).repartition(buckets, "ticker").sortWithinPartitions("ticker", "bar_date").write.mode("append").bucketBy(buckets, "ticker").sortBy("ticker", "bar_date").format("parquet").saveAsTable(table)
