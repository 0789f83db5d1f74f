"""A Merkle manifest of a dataset, and proofs that a row belongs to it.

Rows are leaves: a digest of their columns.  Leaves of a group (a language) in order are
joined, eight at a time, until one node is left; the nodes of the groups in order are
joined alike to the root.  The manifest is a store of records from a digest to its
children, so it is addressed by content alone.

A proof is found by descent: the digits of a leaf's rank (to the base of eight) say which
child to take at every record from the root on; the children not taken are a segment of
the path, and the segments in reverse are the proof.  Requests that have the beginning
of their ranks in common descend together, so a record is read once for each place it
has in the tree and not once for each leaf below it.

Ranks come from range partitions with counts, so no group of rows is ever in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, sized, written

#: Children of a node.
FAN = 8
#: Rows of a range on average, at most.
RANGE_ROWS = 1_000_000
#: Records (of some 300 bytes) that are broadcast at most.
RECORDS = 20_000


def digest(*parts: Column) -> Column:
    """sha256 of the parts together, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def packed(hex_text: Column) -> Column:
    return F.unhex(hex_text)


def text_of(packed_digests: Column) -> Column:
    return F.lower(F.hex(packed_digests))


def framed(x: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, `-` for null."""
    s = x.cast("string")
    return F.when(s.isNotNull(), F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)).otherwise(F.lit("-"))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Manifest:
    """Leaves with places, groups with subroots, and the records by level; `root` is the root's digest (empty without rows)."""

    #: The leaves' columns, grp (the place of the group, from 0), pos (the leaf's place in it) and the depth of the group's tree.
    leaves: DataFrame
    #: grp, depth, subroot.
    groups: DataFrame
    root: str
    #: Records (digest, children) of the groups' trees and of the tree over groups, level by level from the lowest.
    trees: list[DataFrame] = field(default_factory=list)
    top: list[DataFrame] = field(default_factory=list)


def placed(rows: DataFrame, grp: str, order: list[str]) -> DataFrame:
    """Written rows with pos, their place (from 0) in the order of their group, nulls first; equal rows are in any order.

    Rows go to ranges of (group, order), with a running number that splits runs of equal
    rows; what the ranges before hold of a group is where a range starts.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in (grp, *order)]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, F.col("__tie"))
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()))
    count = written(ranged.groupBy("__part", grp).agg(F.count("*").alias("__n")))
    before = F.sum("__n").over(Window.partitionBy(grp).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    start = count.select(F.col("__part").alias("__p"), F.col(grp).alias("__g"), F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part", grp).orderBy(*keys[1:], "__tie"))
    out = ranged.withColumn("__k", inside).join(sized(written(start)), (F.col("__part") == F.col("__p")) & F.col(grp).eqNullSafe(F.col("__g")))
    return out.withColumn("pos", F.col("__start") + F.col("__k") - 1).drop("__part", "__p", "__g", "__k", "__start", "__tie")


def _grown(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(grp, digest) of each group's last node, and the records of every level, from nodes (grp, pos, n, digest); n is the number of nodes of the group."""
    tops, records = nodes.where("n = 1").select("grp", "digest"), []
    while most > 1:
        joined = nodes.where("n > 1").groupBy("grp", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"].alias("children"))
        nodes = written(joined.withColumn("digest", packed(F.sha2(F.array_join(F.transform("children", text_of), ""), 256))))
        records.append(written(nodes.select("digest", "children").dropDuplicates(["digest"])))
        tops = tops.union(nodes.where("n = 1").select("grp", "digest"))
        most = -(-most // FAN)
    return tops, records


def build(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of leaves with a column `leaf` (packed digests), grouped by `group` and ordered by `order` within a group, nulls first."""
    base = written(leaves)
    sizes = written(base.groupBy(group).agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    depth, width = F.lit(0), 1
    while width < most:
        depth, width = depth + F.when(F.col("n") > width, 1).otherwise(0), width * FAN
    groups = placed(sizes.withColumn("__all", F.lit(0)), "__all", [group])
    groups = written(groups.select(F.col("pos").alias("grp"), F.col(group).alias("__g"), "n", depth.alias("depth")))
    places = written(placed(base, group, order).join(sized(groups), F.col(group).eqNullSafe(F.col("__g"))).drop("__g"))
    discard(base)
    tops, trees = _grown(places.select("grp", "pos", "n", F.col("leaf").alias("digest")), most)
    subroots = written(groups.join(tops, "grp").select("grp", "depth", F.col("digest").alias("subroot")))
    n = subroots.count()
    last, top = _grown(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("pos"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest")), n)
    root = last.select(text_of(F.col("digest"))).first()
    return Manifest(places, subroots, root[0] if root else "", trees, top)


def _sides(children: str, i: Column) -> Column:
    """The segment of a path at a record: what stands before and after child i (from 0)."""
    side = lambda a, n: F.unhex(F.array_join(F.transform(F.slice(children, a, n), text_of), ""))
    return F.struct(side(F.lit(1), i).alias("before"), side(i + 2, F.lit(FAN)).alias("after"))


def _descend(at: DataFrame, records: DataFrame) -> DataFrame:
    """From nodes (grp, pos, digest, path) to all their children: pos gets the child's digit, path the children not taken.

    Records are found by digest alone.  Few enough of them are broadcast.
    """
    records = sized(records.select(F.col("digest").alias("__d"), "children"), RECORDS)
    step = at.join(records, F.col("digest") == F.col("__d")).select("grp", F.col("pos").alias("__up"), "path", "children", F.posexplode("children").alias("__i", "digest"))
    return step.select("grp", (F.col("__up") * FAN + F.col("__i")).alias("pos"), "digest", F.concat("path", F.array(_sides("children", F.col("__i")))).alias("path"))


def proofs(m: Manifest, columns: list[str], requests: DataFrame | None = None) -> DataFrame:
    """`columns` of the leaves, with leaf, subroot and path: the segments (before, after) from the leaf up.

    `requests` (grp, pos) limits the leaves; all are meant without it.  Leaves of one parent
    are one request as far as their parent.
    """
    leaves = m.leaves
    if requests is not None:
        leaves = leaves.join(requests.select("grp", "pos").distinct(), ["grp", "pos"], "left_semi")
    parent = F.when(F.col("depth") > 0, F.floor(F.col("pos") / FAN)).otherwise(F.lit(0))
    asked = leaves.groupBy("grp", "depth", parent.alias("pos")).agg(F.collect_list(F.struct(F.pmod(F.col("pos"), F.lit(FAN)).cast("int").alias("digit"), "leaf", *columns)).alias("asked"))
    if requests is not None:
        asked = written(asked)

    def wanted(at: DataFrame, height: int) -> DataFrame:
        """Nodes of a height that have requests below them."""
        if requests is None:
            return at
        below = asked.where(F.col("depth") >= height).select("grp", F.floor(F.col("pos") / FAN ** (height - 1)).alias("pos"))
        return at.join(below.distinct(), ["grp", "pos"], "left_semi")

    none = F.array().cast("array<struct<before:binary,after:binary>>")
    at = m.groups.sparkSession.range(1 if m.root else 0).select(F.lit(0).alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(m.root).alias("h"), none.alias("path"))
    at = at.select("grp", "pos", packed(F.col("h")).alias("digest"), "path")
    for records in reversed(m.top):
        at = _descend(at, records)
    starts = written(at.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "digest", "path").join(sized(m.groups.select("grp", "depth")), "grp"))
    at = starts.where("false").drop("depth")
    for height in range(len(m.trees), 1, -1):
        at = at.union(starts.where(F.col("depth") == height).select(*at.columns))
        at = _descend(wanted(at, height), m.trees[height - 1])
    # Parents of leaves: their children are looked up by digest too, for the leaves asked for.
    at = at.union(starts.where("depth = 1").select(*at.columns))
    found = starts.where("depth = 0").join(asked.where("depth = 0"), ["grp", "pos"]).select("grp", "path", F.explode("asked").alias("a"))
    if m.trees:
        last = at.join(asked.where("depth > 0"), ["grp", "pos"])
        last = last.join(sized(m.trees[0].select(F.col("digest").alias("__d"), "children"), RECORDS), F.col("digest") == F.col("__d")).select("grp", "path", "children", F.explode("asked").alias("a"))
        found = found.union(last.select("grp", F.concat("path", F.array(_sides("children", F.col("a.digit")))), "a"))
    found = found.join(sized(m.groups.select("grp", "subroot")), "grp")
    return found.select(*(F.col(f"a.{c}").alias(c) for c in columns), F.col("a.leaf").alias("leaf"), "subroot", F.reverse("path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(text_of(s["before"]), at, text_of(s["after"])), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level and left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(text_of(s["before"]), text_of(s["after"]))), "")


def verified_rows(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `docs`.

    A leaf is the digest of `columns`, each framed by its length (`-` for null); a missing
    column counts as null.  Rows of a group ascend by id (nulls first), rows of one id by
    their digests; rows that are equal throughout are leaves of their own with any of
    their places.  `tampered` says which rows are read back with A-Z in their text lower-cased;
    by default those whose id's crc32 (as decimal text) is divisible by 3 (a null id is not).
    A null id, group or text is a value as any other; ids may have any type that has an order
    and a text.  Other columns are not used; an empty table gives an empty one.
    """
    col = lambda c: F.col(f"`{c}`") if c.lower() in {x.lower() for x in docs.columns} else F.lit(None).cast("string")
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
    parts = [framed(col(c)) for c in columns]
    changed = [framed(lower_ascii(col(c))) if c == text_col else p for c, p in zip(columns, parts, strict=True)]
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("lang"), packed(digest(*parts)).alias("leaf"), F.when(tampered, packed(digest(*changed))).alias("seen"))
    m = build(thin, "lang", ["doc_id", "leaf"])
    out = proofs(m, ["doc_id", "seen"])
    leaf = text_of(F.col("leaf"))
    out = out.select("doc_id", leaf.alias("leaf"), text_of(F.col("subroot")).alias("subroot"), F.lit(m.root).alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce(text_of(F.col("seen")), leaf), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
