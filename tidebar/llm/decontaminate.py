"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame operations only.

An item is contained in a document if the share `threshold` or more of its distinct
word shingles stands in the document's set.  Items are split into classes by size, as
the size rules how many of an item's q shingles a document may miss, and each class has
an index of its own.  An item's sketch is its q - ceil(threshold * q) + 1 smallest
shingle hashes: a document that contains the item cannot miss all of them, so testing
the sketches of a class against the document's whole set finds every such document,
however long it is.  A document is a candidate for a class only, if it has as many
shingles as the class's smallest item needs, and is then verified against the items of
that class by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import sized, written

WORD = r"[^\x20\x09-\x0D]+"
K = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def starts(w: Column, k: int) -> Column:
    """The places of the runs of k words, from 0."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, k: int) -> Column:
    return F.transform(starts(w, k), lambda i: F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))))


def shingles(w: Column, k: int) -> Column:
    return F.transform(starts(w, k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))


def by_width(w: Column, width: Column, make) -> Column:
    out = F.array().cast("array<string>" if make is shingles else "array<bigint>")
    for k in range(1, K + 1):
        out = F.when(width == k, make(w, k)).otherwise(out)
    return out


def of_width(classes: str, k: int) -> Column:
    return F.filter(classes, lambda c: c["width"] == k)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item for each item that a document contains.

    Words are lower-cased runs of other characters than white space.  Items of fewer
    than five words are one shingle of all their words; items without words are
    contained nowhere.  Null texts are empty.  Rows of one document id are one
    document with all their shingles; rows of one item id are items of their own, of
    which the pair of ids shows the largest share.  A null id is an id.  Other
    columns are not used.
    """
    item = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("width", F.least(F.size("w"), F.lit(K)))
    item = item.select("item_id", "width", F.array_sort(F.array_distinct(by_width(F.col("w"), F.col("width"), hashes))).alias("h"), F.array_distinct(by_width(F.col("w"), F.col("width"), shingles)).alias("shingles"))
    item = item.withColumn("need", F.ceil(F.size("shingles") * F.lit(threshold) - 1e-9).cast("int")).withColumn("class", F.floor(F.log2(F.size("shingles"))).cast("int"))
    item = written(item.withColumn("row", F.monotonically_increasing_id()))
    sketch = item.select("width", "class", F.explode(F.slice("h", F.lit(1), F.size("h") - F.least("need", F.size("h")) + 1)).alias("hash")).distinct()
    # Narrow rows by number and length; a hash that many items share is one row a class.
    sketch = sized(written(sketch))
    needs = {(r["width"], r["class"]): r["need"] for r in item.groupBy("width", "class").agg(F.min("need").alias("need")).collect()}  # 5 widths, some 30 sizes
    widths = sorted({k for k, _ in needs})

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    w = base.select("doc_id", words(F.col("text")).alias("w"))
    nothing = base.limit(0)
    found = nothing.select("doc_id", F.lit(0).alias("width"), F.lit(0).alias("class"))
    for k in widths:
        probe = w.select("doc_id", F.explode(hashes(F.col("w"), k)).alias("hash"))
        found = found.union(probe.join(sketch.where(F.col("width") == k), "hash").select("doc_id", "width", "class"))
    candidates = written(found.distinct())
    some = sized(written(candidates.groupBy(F.col("doc_id").alias("cid")).agg(F.collect_set(F.struct("width", "class")).alias("classes"))))  # at most one entry a class
    suspects = base.join(some, base["doc_id"].eqNullSafe(some["cid"])).select("doc_id", words(F.col("text")).alias("w"), "classes")
    pairs = nothing.select("doc_id", F.lit(None).cast(item.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item"))
    for k in widths:
        mine = of_width("classes", k)
        own = suspects.where(F.size(mine) > 0).select("doc_id", F.transform(mine, lambda c: c["class"]).alias("classes"), "w")
        # Rows of one id are one document, as large as they are together.
        size = sized(written(own.groupBy(F.col("doc_id").alias("sid")).agg(F.sum(F.greatest(F.size("w") - k + 1, F.lit(0))).alias("n"))))
        low = F.create_map(*(F.lit(x) for (width, c), need in sorted(needs.items()) if width == k for x in (c, need)))
        large = own.join(size, own["doc_id"].eqNullSafe(size["sid"])).select("doc_id", "n", F.explode("classes").alias("class"), "w").where(F.col("n") >= low[F.col("class")])
        large = large.select("doc_id", "class", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("shingle"))
        part = item.where(F.col("width") == k).select("row", "item_id", "class", "need", F.size("shingles").alias("n_item"), F.explode("shingles").alias("shingle"))
        part = large.join(sized(written(part)), ["class", "shingle"]).groupBy("doc_id", "row", "item_id", "need", "n_item").agg(F.countDistinct("shingle").alias("n_shared"))
        pairs = pairs.union(part.where("n_shared >= need").select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item")))
    best = F.max_by(F.struct("n_shared", "n_item"), F.col("n_shared") / F.col("n_item"))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_shared", "b.n_item")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of `docs` that contain no item; rows of one id go or stay together."""
    bad = sized(written(contained_items(docs, items, id_col=id_col, **more).select(F.col("doc_id").alias("__bad")).distinct()))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")
