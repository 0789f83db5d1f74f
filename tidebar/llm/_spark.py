"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: A side is broadcast only when counted and no larger than this many rows of at most a few numbers.
BROADCAST_ROWS = 1_000_000
#: And its texts must be no more bytes than this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session (tests) may go without and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage and outlives executors.

    It goes when the application ends, or earlier by `discard` once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    store, hadoop = _hadoop(spark, path)
    store.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of `written` that no plan still to run reads."""
    for df in tables:
        if df is not None:
            store, hadoop = _hadoop(df.sparkSession, df.written_to)
            store.delete(hadoop, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only if its count and the bytes of its texts are within their limits."""
    if df.limit(limit + 1).count() > limit:
        return df
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    if texts and (df.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def with_long_ids(df: DataFrame, column: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`df` with `column` as a long, and a function that puts the ids back into named columns of a result.

    Integers are taken as they are.  Ids of any other type that can be ordered get their
    places among all distinct ids, so the smallest id stays the smallest; null stays null.
    """
    if isinstance(df.schema[column].dataType, (Ty.IntegralType, Ty.NullType)):
        return df.withColumn(column, F.col(column).cast("long")), lambda out, *columns: out
    ids = df.select(F.col(column).alias("__id")).where("__id is not null").distinct()
    ids = written(ids.repartitionByRange("__id").withColumn("__part", F.spark_partition_id()))
    sizes = ids.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.expr("sum(n) OVER (ORDER BY __part) - n").alias("before"))  # one row a partition
    place = F.expr("row_number() OVER (PARTITION BY __part ORDER BY __id)")
    ids = written(ids.withColumn("__place", place).join(F.broadcast(before), "__part").select("__id", (F.col("__place") + F.col("before") - 1).alias("__no")))

    def back(out: DataFrame, *columns: str) -> DataFrame:
        names = out.columns
        for c in columns:
            out = out.join(ids.select(F.col("__no").alias(c), F.col("__id")), c, "left").drop(c).withColumnRenamed("__id", c)
        return out.select(*names)

    numbered = df.join(ids.withColumnRenamed("__id", column), column, "left")
    return numbered.select(*(F.col("__no").alias(column) if c == column else F.col(c) for c in df.columns)), back


def _with_low(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (u, v) with m, the smallest v of their u.

    Nodes of more than `limit` edges, the centres of stars, get m by broadcast (there are
    at most edges / limit of them), so that no task gets all edges of one.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").union(cold.select("u", "v", "m"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node at most, and only to such that point nowhere."""
    ends = edges.select("u", F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("n")).where("out > 1 or out > 0 and n > out").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that links to a smaller one; root is the smallest node that links reach.

    Alternating large-star and small-star rounds until only stars are left: each is a few grouped
    minima and joins, and the number of rounds is logarithmic in practice.  Roots themselves are not
    listed; nulls are dropped.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    limit = max(64, now.count() // 2000)
    while not _is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_low(both, limit).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # A node's larger neighbours and the node itself all point to its smallest one.
        small = _with_low(large, limit).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        before, now = now, written(small)
        discard(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
