"""A corpus pipeline made of the operators in tidebar.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`; the last
one returns the training order.  Stages work on columns of neutral names, so a table may
have any other columns, also ones that an operator adds itself or with dots in their
names; all come back as they were.

Defined results: null and empty texts are not toxic, copies of nothing and free of
benchmark items; they are mixed in without cost.  Rows that repeat id and text are one
document for the second stage, which keeps one of them; rows of one id with different
texts stay or go together.  Rows without an id stay, one for each text.  Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontaminate, mixing, near_dedup, toxicity, training_order
from tidebar.llm._spark import sized, written

ID, TEXT, SOURCE = "doc_id", "text", "source"


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns c0, c1, ... and which of them are id, text and source."""
    names = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {x: names[x] for x in (ID, TEXT, SOURCE) if x in names}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by labels of the table `labels`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, at = plain(docs)
    labels = labels.select(F.col(ID).alias(at[ID]), "toxic")
    scored = toxicity.toxicity(rows, labels, id_col=at[ID], text_col=at[TEXT])
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def without_copies_of_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One of the rows that share id and text.  Only rows whose id repeats or is null are moved."""
    often = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(F.col(key).alias("__often"))
    often = sized(written(often))
    match = rows[key].eqNullSafe(often["__often"])
    odd = rows.join(often, match, "left_semi")
    first = F.expr(f"row_number() OVER (PARTITION BY {key}, xxhash64({text}), {text} ORDER BY 1)")
    return rows.join(often, match, "left_anti").union(odd.withColumn("__k", first).where("__k = 1").drop("__k"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similarity 0.8 or more."""
    rows, at = plain(docs)
    found = near_dedup.near_duplicates(rows, id_col=at[ID], text_col=at[TEXT], threshold=0.8)
    gone = sized(written(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()))
    left = rows.join(gone, rows[at[ID]] == gone["__gone"], "left_anti")
    return without_copies_of_rows(left, at[ID], at[TEXT]).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the table `benchmark`."""
    rows, at = plain(docs)
    return decontaminate.clean_documents(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=at[ID], text_col=at[TEXT]).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    rows, at = plain(docs)
    mixed = mixing.mix_sources(rows, id_col=at[ID], text_col=at[TEXT], source_col=at[SOURCE])
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*docs.columns)


def order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order; repeated documents are sequences of their own."""
    return training_order.training_order(docs.select(ID, TEXT))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token_output", order),
]

#: SQL cannot express the first stage; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
