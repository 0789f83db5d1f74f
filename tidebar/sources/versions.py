"""Tables of partitions with manifests: a write replaces the partitions that it touches, and readers see all of it or nothing.

A manifest names the folder of each partition.  A write lays down new folders and then
the manifest with the next number, which only one writer can create; a writer that comes
second gets an error and its folders are never read.  Old manifests and the
folders that only they name are removed after a few versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import _at, kept, remove
from .tables import CONFIRMATION, KEY, upsert

#: Versions that stay readable.
KEEP = 3


class ConcurrentWrite(RuntimeError):
    """Another writer has created the version first."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, folder = _at(spark, f"{path}/manifest")
    return sorted(int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit()) if store.exists(folder) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, manifest) of the newest version; (0, {}) for a new table.  One that is still being written does not count."""
    for n in reversed(_numbers(spark, path)):
        text = spark.read.text(f"{path}/manifest/{n:012d}", wholetext=True).collect()
        try:
            return n, json.loads(text[0][0])
        except (IndexError, ValueError):
            continue
    return 0, {}


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Creates version `number`; an error if it exists."""
    store, target = _at(spark, f"{path}/manifest/{number:012d}")
    try:
        out = store.create(target, False)
    except Exception as e:
        if store.exists(target):
            raise ConcurrentWrite(f"version {number} of {path} exists") from e
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def expire(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Removes versions but the newest `keep`, and folders that no remaining one names."""
    numbers = _numbers(spark, path)
    read = lambda n: json.loads(spark.read.text(f"{path}/manifest/{n:012d}", wholetext=True).first()[0])["partitions"]
    left = {folder for n in numbers[-keep:] for folder in read(n).values()}
    for n in numbers[:-keep]:
        for folder in set(read(n).values()) - left:
            remove(spark, f"{path}/{folder}")
        remove(spark, f"{path}/manifest/{n:012d}")


def read_table(spark: SparkSession, path: str, partitions: list[str] | None = None) -> DataFrame:
    """The rows of the newest version, of some partitions only if these are named."""
    _, m = manifest(spark, path)
    if not m:
        raise FileNotFoundError(f"no table at {path}")
    folders = [f"{path}/{f}" for p, f in sorted(m["partitions"].items()) if partitions is None or p in partitions]
    schema = StructType.fromJson(m["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace_all(df: DataFrame, path: str, keep: int = KEEP) -> None:
    """The rows become the whole table; they may have been read from it."""
    spark = df.sparkSession
    n, _ = manifest(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    commit(spark, path, n + 1, {"schema": json.loads(df.schema.json()), "partitions": {"all": folder}})
    expire(spark, path, keep)


def month(day: str = "signal_date") -> Column:
    return F.date_format(F.to_date(day), "yyyy-MM")


def upsert_months(new: DataFrame, path: str, now=None, day: str = "signal_date", key: list[str] = KEY, keep_old: list[str] = CONFIRMATION, stamp: str = "updated_at", keep: int = KEEP) -> list[str]:
    """Upserts rows by key (which has the day) and rewrites the months of their days only; gives those months.

    Rows without a day are a partition of their own.  The first write takes its columns from the
    new rows, with created_at and the stamp.
    """
    spark = new.sparkSession
    at = F.coalesce(month(day), F.lit("none"))
    rows = kept(new)
    touched = sorted(r[0] for r in rows.select(at.alias("m")).distinct().collect())
    n, m = manifest(spark, path)
    if "all" in m.get("partitions", {}):
        raise ValueError(f"{path} is one whole, not a table of months")
    if m:
        old = read_table(spark, path, touched)
    else:
        stamps = ", ".join(f"{c} timestamp" for c in ("created_at", stamp) if c not in new.columns)
        old = spark.createDataFrame([], StructType([*new.schema.fields, *(StructType.fromDDL(stamps).fields if stamps else [])]))
    out = upsert(old, rows, key=key, keep_old=keep_old, stamp=stamp, now=now).select(*old.columns)
    name = f"data/{uuid.uuid4().hex}"
    out.withColumn("__month", at).repartition("__month").write.partitionBy("__month").parquet(f"{path}/{name}")
    partitions = {**m.get("partitions", {}), **{p: f"{name}/__month={p}" for p in touched}}
    commit(spark, path, n + 1, {"schema": json.loads(out.schema.json()), "partitions": partitions})
    expire(spark, path, keep)
    return touched
