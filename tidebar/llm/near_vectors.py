"""Near-duplicate vectors by cross-polytope hashing.

Unit vectors are turned by three rounds of random signs and a fast Hadamard
transform; the hash of one rotation is the signed axis nearest to the result.
A table's bucket is a few such hashes with the label.  Each vector is stored in its
own bucket of every table and also looks into the buckets where one hash is the
second nearest axis (multiprobe).  Candidates are verified by cosine in double
precision.  Equal vectors of a label are one class, so copies make no pairs.

Small buckets give candidate pairs as rows.  Buckets of more than HOT classes never do:
1. their members, and those that look into them, form clusters;
2. vectors within half the threshold's angle of the mean of their cluster's largest
   bucket are all linked with each other (angles obey the triangle inequality), so
   they are counted without being compared;
3. the rest of a cluster is compared block by block, with each other and with
   the core; a block gives counts and spanning links, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import components, sized, with_long_ids, written

#: Tables at least, and the share of pairs at the threshold that all tables together may miss.
TABLES, ROUNDS, MISSED = 10, 3, 0.005
#: Narrower vectors are turned in so many dimensions: in two or three there are too few different turns.
LEAST_DIMS = 16
#: Classes of a bucket from which on it is counted in blocks, and classes in a block.
HOT, BLOCK = 256, 250
#: A bucket's hashes are as many as keep an even spread of a label's classes below so many a bucket.
SPREAD = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the width is a power of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
        h *= 2
    return x


def signs(turn: int, width: int) -> np.ndarray:
    bits = T.mix(np.arange(width, dtype=np.uint64), turn + 100) >> np.uint64(63)
    return 1.0 - 2.0 * bits.astype(float)


def hashes(x: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each turned row."""
    for r in range(ROUNDS):
        x = hadamard(x * signs(turn * ROUNDS + r, x.shape[1]))
    size = np.abs(x)
    row = np.arange(len(x))
    best = size.argmax(axis=1)
    size[row, best] = -1
    second = size.argmax(axis=1)
    code = lambda i: (2 * i + (x[row, i] < 0)).astype(np.uint64)
    return code(best), code(second)


def n_hashes(classes: int, dims: int) -> int:
    """Hashes in a bucket: two, or more for so many classes of one label."""
    return max(2, math.ceil(math.log(max(1.0, classes / SPREAD)) / math.log(2 * max(2, dims))))


def n_tables(width: int, dims: int, threshold: float, pairs: int = 300) -> int:
    """So many tables that about 1 - MISSED of the pairs at the threshold share a bucket of one.

    The chance of one table is measured on made-up pairs of vectors of `dims` dimensions at exactly the
    threshold, so stricter buckets, other thresholds and few dimensions get more tables.
    """
    rng = np.random.default_rng(1)
    x = rng.normal(size=(pairs, max(2, dims)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y / np.linalg.norm(y, axis=1)[:, None]
    (a, a_looks), (b, b_looks) = buckets(x, width), buckets(y, width)
    met = a == b
    for k in range(width):
        met |= (a_looks[:, k::width] == b) | (b_looks[:, k::width] == a)
    chance = min(max(float(met.mean()), 1e-6), 1 - 1e-9)
    # Some pairs lie worse than the mean: half as many tables again.
    return max(TABLES, math.ceil(1.5 * math.log(MISSED) / math.log(1 - chance)))


def buckets(x: np.ndarray, width: int = 2, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row its bucket in every table, and the other buckets it looks into."""
    dims = max(LEAST_DIMS, 1 << max(1, int(x.shape[1] - 1).bit_length()))
    x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
    own, probes = [], []
    for t in range(tables):
        best, second = zip(*(hashes(x, t * width + k) for k in range(width)), strict=True)
        key = lambda codes, t=t: T.mix(sum(c * T._FACTOR[i] for i, c in enumerate(codes)), t + 1)
        own.append(key(best))
        probes += [key([second[i] if i == k else best[i] for i in range(width)]) for k in range(width)]
    return np.stack(own, axis=1).view(np.int64), np.stack(probes, axis=1).view(np.int64)


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Double vectors; None where the vector is null, empty or zero or holds a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in column:
        values = v.values if v.is_valid else None
        x = None
        if values is not None and len(values) and not values.null_count:
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            x = x / top if np.isfinite(x).all() and top > 0 else None  # scaled, so that no square over- or underflows
        out.append(x)
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vec", pa.binary())])
    for batch in batches:
        rows = _rows(batch.column(1))
        labels = batch.column(2).to_pylist()
        usable = [x if y is not None else None for x, y in zip(rows, labels, strict=True)]
        raw = [None if x is None else x.tobytes() for x in usable]
        key = [None if x is None else hashlib.md5(f"{y}:".encode() + x).digest() for x, y in zip(raw, labels, strict=True)]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), labels, key, raw], schema=schema)


def matrices(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as a matrix) of the vectors of each length."""
    size = np.array([len(x) for x in raw], np.int64)
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        yield which, np.frombuffer(b"".join(raw[i] for i in which), np.float64).reshape(len(which), -1)


def _index(width: int, tables: int = TABLES):
    schema = pa.schema([("key", pa.binary()), ("own", pa.list_(pa.int64())), ("probe", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The label and the vector's length are part of a bucket.
            salt = [int.from_bytes(hashlib.blake2b(f"{y}:{len(v)}".encode(), digest_size=8).digest(), "little", signed=True) for y, v in zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist(), strict=True)]
            for which, x in matrices(batch.column("vec").to_pylist()):
                own, probe = (b ^ np.array(salt, np.int64)[which, None] for b in buckets(x / np.linalg.norm(x, axis=1)[:, None], width, tables))
                yield pa.record_batch([batch.column("key").take(pa.array(which)), list(own), list(probe)], schema=schema)

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of the threshold or more, as a table; close calls are taken one by one."""
    cosine = (x @ y.T) / np.sqrt(np.einsum("ij,ij->i", x, x)[:, None] * np.einsum("ij,ij->i", y, y))
    out = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    out[i, j] = cosines(x[i], y[j]) >= threshold
    return out


def _verify(threshold: float):
    schema = pa.schema([("a_key", pa.binary()), ("b_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_vec").to_pylist(), batch.column("b_vec").to_pylist()
            good = [np.zeros(0, np.int64)]
            for (which, x), (_, y) in zip(matrices(a), matrices(b), strict=True):
                good.append(which[cosines(x, y) >= threshold])
            got = batch.take(pa.array(np.concatenate(good)))
            yield pa.record_batch([got.column("a_key"), got.column("b_key")], schema=schema)

    return run


def _partial_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by cluster: one row for each cluster of a batch."""
    for batch in batches:
        cluster = batch.column("cluster").to_numpy()
        raw = batch.column("vec").to_pylist()
        ids, sums = [], []
        for which, x in matrices(raw):
            x = x / np.linalg.norm(x, axis=1)[:, None]
            c, at = np.unique(cluster[which], return_inverse=True)
            total = np.zeros((len(c), x.shape[1]))
            np.add.at(total, at, x)
            ids += c.tolist()
            sums += [t.tobytes() for t in total]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sums, pa.binary())], names=["cluster", "mean"])


def _total_mean(table: pa.Table) -> pa.Table:
    """A cluster's mean from its sums, one for each batch that holds some of it."""
    total = None
    for x in table.column("mean"):
        x = np.frombuffer(x.as_py(), np.float64)
        total = x.copy() if total is None else total + x if len(x) == len(total) else total
    return pa.table({"cluster": table.column("cluster").slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})


def _core(threshold: float):
    """Marks what lies within half the threshold's angle of its cluster's mean, less a margin for rounding."""
    least = math.cos(math.acos(threshold) / 2 - 1e-7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, mean = batch.column("vec").to_pylist(), batch.column("mean").to_pylist()
            core = np.zeros(len(raw), bool)
            for i, (x, y) in enumerate(zip(raw, mean, strict=True)):
                if len(x) == len(y):
                    a, b = np.frombuffer(x), np.frombuffer(y)
                    size = np.sqrt((a @ a) * (b @ b))
                    core[i] = size > 0 and a @ b >= least * size
            yield pa.record_batch([*(batch.column(c) for c in ("key", "rep", "n", "cluster", "vec")), pa.array(core)], names=["key", "rep", "n", "cluster", "vec", "core"])

    return run


def spanning(links: np.ndarray) -> np.ndarray:
    """For each row and each column of a table of links the smallest row that they are connected with (itself if none)."""
    rows, columns = links.shape
    low, right = np.arange(rows), np.full(columns, rows)
    while True:
        right = np.where(links, low[:, None], rows).min(axis=0, initial=rows)
        new = np.minimum(low, np.where(links, right, rows).min(axis=1, initial=rows))
        if (new == low).all():
            return np.concatenate((low, right))
        low = new


def _compare(threshold: float):
    """Counts and spanning links between two blocks, or inside one (side 2)."""

    def run(table: pa.Table) -> pa.Table:
        side, rep, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
        raw = table.column("vec").to_pylist()
        out: list[list] = [[], [], [], []]
        for which, x in matrices(raw):
            left, right = which[side[which] != 1], which[side[which] > 0]
            if not len(left) or not len(right):
                continue
            found = linked(x[np.searchsorted(which, left)], x[np.searchsorted(which, right)], threshold)
            if side[left[0]] == 2:
                np.fill_diagonal(found, False)
                members, count = left, found @ n[right]
                root = spanning(found | np.eye(len(left), dtype=bool))[: len(left)]
            else:
                members, count = np.concatenate((left, right)), np.concatenate((found @ n[right], found.T @ n[left]))
                root = spanning(found)
            some = count > 0
            out[0] += table.column("key").take(pa.array(members[some])).to_pylist()
            out[1] += count[some].tolist()
            out[2] += rep[members[some]].tolist()
            out[3] += rep[left[root[some]]].tolist()
        return pa.table([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "others", "a", "b"])

    return run


def _block_tasks(count: DataFrame) -> DataFrame:
    """(cluster, core, block, task, side) of all pairs of blocks of a cluster but those inside its core; side 2: both at once."""
    a, b = (count.select(F.col("cluster"), F.col("core").alias(f"{x}_core"), F.col("blocks").alias(f"{x}_blocks")) for x in "ab")
    pair = a.join(b, "cluster").where("not a_core")
    pair = pair.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    pair = pair.where("b_core or i <= j").withColumn("task", F.xxhash64("cluster", "b_core", "i", "j"))
    one = ~F.col("b_core") & (F.col("i") == F.col("j"))
    left = pair.select("cluster", F.col("a_core").alias("core"), F.col("i").alias("block"), "task", F.when(one, 2).otherwise(0).alias("side"))
    right = pair.where(~one).select("cluster", F.col("b_core").alias("core"), F.col("j").alias("block"), "task", F.lit(1).alias("side"))
    return left.union(right)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, hot: int = HOT) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors`.

    Vectors are compared only within equal, non-null labels and equal lengths.
    Null, empty or zero vectors and those with a null or non-finite component link
    with nothing, not even with copies.  Each row is a vector of its own, also where
    rows repeat; rows of one id are one node, each with its own count.  About one link in 200 at
    the threshold may be missed, whatever the dimensions, threshold and size.  A null id links
    with nothing; ids are of any type that can be ordered.  Other columns are not used; an empty table gives an empty one.
    """
    rows, back = with_long_ids(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label")), "vec_id")
    base = written(rows.mapInArrow(_prepare, "vec_id long, label string, key binary, vec binary"))
    usable = base.where("key is not null and vec_id is not null")
    classes = written(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    most = classes.groupBy("label").agg(F.count("*").alias("m"), F.min(F.octet_length("vec")).alias("bytes")).agg(F.max("m").alias("m"), F.min("bytes").alias("bytes")).first()
    dims = (most["bytes"] or 8) // 8
    # More than two hashes of vectors of two or three dimensions leave some angles apart in every table.
    width = n_hashes(most["m"] or 0, max(LEAST_DIMS, dims)) if dims > 3 else 2
    tables = n_tables(width, dims, threshold)
    index = written(classes.select("key", "label", "vec").mapInArrow(_index(width, tables), "key binary, own array<long>, probe array<long>"))
    stored = index.select(F.explode("own").alias("bucket"), F.col("key").alias("b_key"))
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("m"), F.min("b_key").alias("first"))
    big = sized(written(sizes.where(F.col("m") > hot)))  # one row for each `hot` entries at most

    # Clusters: whoever is stored in a hot bucket or looks into it.
    looks = index.select(F.col("key").alias("a_key"), F.explode(F.concat("own", "probe")).alias("bucket"))
    size = classes.select("key", "rep", "n")
    warm = written(looks.join(big, "bucket").join(size.select(F.col("key").alias("a_key"), "rep"), "a_key").join(size.select(F.col("key").alias("first"), F.col("rep").alias("first_rep")), "first").select("a_key", "rep", "first_rep", "bucket", "m").distinct())
    joint = components(warm.select(F.col("rep").alias("a"), F.col("first_rep").alias("b")))
    cluster = warm.join(joint.select(F.col("node").alias("rep"), "root"), "rep", "left").select("a_key", "bucket", "m", F.coalesce("root", "rep").alias("cluster"))
    top = cluster.groupBy("cluster").agg(F.max_by("bucket", F.struct("m", "bucket")).alias("bucket"))
    cluster = written(cluster)
    members = cluster.select(F.col("a_key").alias("key"), "cluster").distinct().join(classes, "key")
    largest = cluster.join(top, ["cluster", "bucket"]).select(F.col("a_key").alias("key"), "cluster").join(classes.select("key", "vec"), "key")
    mean = largest.select("cluster", "vec").mapInArrow(_partial_means, "cluster long, mean binary").groupBy("cluster").applyInArrow(_total_mean, "cluster long, mean binary")
    members = written(members.join(mean, "cluster").select("key", "rep", "n", "cluster", "vec", "mean").mapInArrow(_core(threshold), "key binary, rep long, n long, cluster long, vec binary, core boolean"))
    core = members.where("core").groupBy("cluster").agg(F.sum("n").alias("core_n"), F.min("rep").alias("core_rep"))
    in_core = written(members.where("core").join(core, "cluster").select("key", (F.col("core_n") - F.col("n")).alias("others"), F.col("rep").alias("a"), F.col("core_rep").alias("b")))
    count = members.groupBy("cluster", "core").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(count, ["cluster", "core"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sent = dealt.join(_block_tasks(count), ["cluster", "core", "block"])
    blocks = written(sent.select("task", "side", "key", "rep", "n", "vec").groupBy("task").applyInArrow(_compare(threshold), "key binary, others long, a long, b long"))

    # Pairs of the other buckets, less those inside a cluster.
    marked = index.join(sized(members.select("key", "cluster")), "key", "left")
    cool = marked.select(F.explode("own").alias("bucket"), F.col("key").alias("b_key"), F.col("cluster").alias("b_cluster")).join(big.select("bucket"), "bucket", "left_anti")
    asks = marked.select(F.explode(F.concat("own", "probe")).alias("bucket"), F.col("key").alias("a_key"), F.col("cluster").alias("a_cluster"))
    pairs = asks.join(cool, "bucket").where("a_key <> b_key and (a_cluster is null or b_cluster is null or a_cluster <> b_cluster)")
    pairs = pairs.select(F.least("a_key", "b_key").alias("a_key"), F.greatest("a_key", "b_key").alias("b_key")).distinct()
    a = classes.select(F.col("key").alias("a_key"), F.col("vec").alias("a_vec"))
    b = classes.select(F.col("key").alias("b_key"), F.col("vec").alias("b_vec"))
    links = written(pairs.join(a, "a_key").join(b, "b_key").select("a_key", "b_key", "a_vec", "b_vec").mapInArrow(_verify(threshold), "a_key binary, b_key binary"))
    ends = links.join(size.select(F.col("key").alias("a_key"), F.col("rep").alias("a"), F.col("n").alias("a_n")), "a_key").join(size.select(F.col("key").alias("b_key"), F.col("rep").alias("b"), F.col("n").alias("b_n")), "b_key")
    ends = written(ends)
    degree = ends.select(F.col("a_key").alias("key"), F.col("b_n").alias("others")).union(ends.select("b_key", "a_n")).union(in_core.select("key", "others")).union(blocks.select("key", "others")).groupBy("key").agg(F.sum("others").alias("others"))
    member = usable.select("vec_id", "key").join(size, "key")
    twice = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    edges = ends.select("a", "b").union(in_core.select("a", "b")).union(blocks.select("a", "b")).union(member.join(twice, "vec_id").select("a", F.col("rep").alias("b")))
    roots = components(edges)
    known = size.join(degree, "key", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = base.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    component = F.coalesce("root", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return back(out, "vec_id", "component_id")
