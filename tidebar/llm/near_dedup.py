"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, a 128-value MinHash
   signature, and 25 band keys of 5 values each.  Two sets of Jaccard
   similarity 0.85 miss all bands with probability 4e-7.
2. Texts with equal sets are one class; only one member goes on.
3. Every member of a band is compared with the band's first member.
4. Signatures of a pair are compared 16 values at a time.  After each batch the
   pair is dropped if the posterior probability that its similarity reaches the
   threshold is below `miss`; the posterior is a Beta distribution.
5. What survives is verified on the full shingle sets.
6. Where a band's members are still in several components, the members of such
   bands form clusters.  A cluster is cut into blocks by size class and hash; pairs of
   blocks are compared as in 4 and 5, except for two members of the cluster's
   largest component, so that no link is lost by the choice of first members and a
   large group of copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import components, sized, with_long_ids, written

HASHES, ROWS, BANDS, BATCH = 128, 5, 25, 16
_A = (T.mix(np.arange(1, HASHES + 1, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (T.mix(np.arange(1, HASHES + 1, dtype=np.uint64), 12) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn."""
    for _, _, raw, off in T.pieces(column):
        start, end, first = T.words(raw, off)
        yield from T.distinct(*T.shingles(T.word_hashes(raw, start, end), first, k))


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([T.mix(s, 3).sum(), T.mix(s, 4).sum()], np.uint64).tobytes()


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets: one row of HASHES 32-bit values for each."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(flat * _A[i] + _B[i], at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    total = (part * T._FACTOR[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)
    return T.mix(total, 5).view(np.int64)


def _features(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sets: list[np.ndarray] = []
            at = 0

            def flush(ids=ids):
                nonlocal sets, at
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signature([sets[i] for i in full]) if full else np.empty((0, HASHES), np.uint32)
                keys, sigs = [None] * len(sets), [None] * len(sets)
                for row, i in enumerate(full):
                    keys[i], sigs[i] = set_key(sets[i]), sig[row].tobytes()
                out = pa.record_batch([ids.slice(at, len(sets)).cast(pa.int64()), [len(s) for s in sets], keys, sigs], schema=schema)
                at, sets = at + len(sets), []
                return out

            size = 0
            for s in shingle_sets(texts, k):
                sets.append(s)
                size += len(s)
                if size > 500_000:
                    yield flush()
                    size = 0
            if sets:
                yield flush()

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        bands = band_keys(sig)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
        yield pa.record_batch([*(batch.column(c) for c in ("rep", "key", "n")), flat], names=["rep", "key", "n", "bands"])


@lru_cache
def required_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """The fewest equal values after 16, 32, ... that keep a pair.

    With a uniform prior, m equal values of n make the similarity's posterior
    Beta(m + 1, n - m + 1); its tail above t is the chance of at most m successes
    in n + 1 trials of probability t.
    """
    need = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, term = 0.0, (1 - threshold) ** (n + 1)
        m = -1
        while tail < miss:
            m += 1
            tail += term
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
        need.append(m)
    return tuple(need)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature arrays pass every batch; dropped rows are not read again."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(required_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        same[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[same[alive] >= need]
    return alive


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("a_sig", "b_sig"))
            yield batch.select(["a", "b", "a_key", "b_key"]).take(pa.array(plausible(a, b, threshold, miss)))

    return run


def _verify(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                keys = zip(part.column("a_key").to_pylist(), part.column("b_key").to_pylist(), strict=True)
                for i, (s, t, (x, y)) in enumerate(zip(shingle_sets(part.column("a_text"), k), shingle_sets(part.column("b_text"), k), keys, strict=True)):
                    if set_key(s) == x and set_key(t) == y:
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if den * both >= num * (len(s) + len(t) - both):
                            found.append(lo + i)
            got = batch.take(pa.array(found, pa.int64()))
            yield pa.record_batch([got.column("a"), got.column("b")], schema=schema)

    return run


#: Members and shingles of a block at most (one document may have more shingles).
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000


def compare_block(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """Links between members of different components, one for each member of `left` and component it reaches.

    Each member of `left` meets those of `right` of like size: signatures are compared
    in batches and pruned by the posterior, the rest is counted exactly.
    """
    sig = signature(sets)
    size = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mark = np.zeros(len(vocabulary), bool)
    root = comp.copy()
    out = []
    for i in left.tolist():
        other = right[(root[right] != root[i]) & (den * np.minimum(size[right], size[i]) >= num * np.maximum(size[right], size[i]))]
        other = other[plausible(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], threshold, miss)]
        if not len(other):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        for j in other.tolist():
            if root[j] != root[i]:
                both = int(mark[flat[ends[j] - size[j] : ends[j]]].sum())
                if den * both >= num * (size[i] + size[j] - both):
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        mark[own] = False
    return out


def _compare(k: int, num: int, den: int, threshold: float, miss: float):
    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        sets, keep = [], []
        for i, (s, key) in enumerate(zip(shingle_sets(texts, k), table.column("key").to_pylist(), strict=True)):
            if set_key(s) == key:
                sets.append(s)
                keep.append(i)
        rep, comp, side = (np.array(table.column(c).to_pylist(), np.int64)[keep] for c in ("rep", "comp", "side"))
        left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero(side > 0)
        links = compare_block(sets, comp, left, right, num, den, threshold, miss) if len(left) and len(right) else []
        return pa.table({"a": pa.array([rep[i] for i, _ in links], pa.int64()), "b": pa.array([rep[j] for _, j in links], pa.int64())})

    return run


def _block_pairs(count: DataFrame) -> DataFrame:
    """(cluster, size class, major, block, task, side) of all pairs of blocks that may hold a link; `count` has the number of blocks.

    Sizes of linked sets differ by less than one class, and two members of a
    cluster's largest component need no comparison.  Side 2: both sides at once.
    """
    a, b = (count.select(*(F.col(c).alias(f"{x}_{c}") for c in count.columns)) for x in "ab")
    pair = a.join(b, F.col("a_cluster") == F.col("b_cluster")).where("b_cls - a_cls in (0, 1) and not (a_major and b_major) and (b_cls > a_cls or not a_major or not b_major) and (b_cls > a_cls or a_major <= b_major)")
    pair = pair.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    same = (F.col("a_cls") == F.col("b_cls")) & (F.col("a_major") == F.col("b_major"))
    pair = pair.where(~same | F.expr("i <= j")).withColumn("task", F.xxhash64("a_cluster", "a_cls", "a_major", "i", "b_cls", "b_major", "j"))
    one = same & (F.col("i") == F.col("j"))
    left = pair.select(F.col("a_cluster").alias("cluster"), F.col("a_cls").alias("cls"), F.col("a_major").alias("major"), F.col("i").alias("block"), "task", F.when(one, 2).otherwise(0).alias("side"))
    right = pair.where(~one).select(F.col("b_cluster").alias("cluster"), F.col("b_cls").alias("cls"), F.col("b_major").alias("major"), F.col("j").alias("block"), "task", F.lit(1).alias("side"))
    return left.union(right)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85, k: int = 5, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of distinct
    k-word shingles is `threshold` or more (compared as an exact fraction).  Null and
    blank texts have no shingles and link with nothing.  Rows that repeat an id are
    one document, which has the links of all its rows.  A row with a null id is
    returned with a null component and kept true.  Ids are of any type that can be ordered.
    Other columns are not used.
    """
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    base, back = with_long_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    feats = written(base.mapInArrow(_features(k), "doc_id long, n long, key binary, sig binary"))
    usable = feats.where("n > 0 and doc_id is not null")
    reps = written(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    member = usable.select("doc_id", "key").join(reps.select("key", "rep"), "key").select("doc_id", "rep")
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    same_id = member.join(twice, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()

    # Each band's members against its first one.
    bands = reps.select("rep", "key", "n", "sig").mapInArrow(_bands, "rep long, key binary, n long, bands array<long>")
    bands = bands.select(F.explode("bands").alias("band"), "rep", "key", "n")
    # Written, so that the join below is one of two plain exchanges, whose hot bands Spark splits.
    first = written(bands.groupBy("band").agg(F.count("*").alias("m"), F.min_by(F.struct("rep", "key", "n"), F.struct("rep", "key")).alias("f")).where("m > 1"))
    shared = written(bands.join(first.select("band", "f"), "band"))
    pairs = shared.where(f"key <> f.key and {den} * least(n, f.n) >= {num} * greatest(n, f.n)").select(F.col("rep").alias("a"), F.col("key").alias("a_key"), F.col("f.rep").alias("b"), F.col("f.key").alias("b_key")).distinct()
    nodes = reps.select("key", "sig")
    pairs = pairs.join(nodes.select(F.col("key").alias("a_key"), F.col("sig").alias("a_sig")), "a_key").join(nodes.select(F.col("key").alias("b_key"), F.col("sig").alias("b_sig")), "b_key")
    likely = written(pairs.select("a", "b", "a_key", "b_key", "a_sig", "b_sig").mapInArrow(_prune(threshold, miss), "a long, b long, a_key binary, b_key binary"))
    need = sized(written(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()))
    text = base.join(need, "doc_id", "left_semi")
    with_a = likely.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    with_b = with_a.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    found = with_b.select("a", "b", "a_key", "b_key", "a_text", "b_text").mapInArrow(_verify(k, num, den), "a long, b long")
    links = written(found.union(same_id).distinct())
    roots = components(links)

    # Bands that still hold several components: their members make clusters, compared block by block.
    now = shared.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    mixed = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    rest = written(now.join(mixed, "band").select("rep", "key", "n", "comp", F.col("f.rep").alias("first")))
    cluster = components(rest.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    rest = rest.select("rep", "key", "n", "comp").distinct().join(cluster.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("cluster", F.coalesce("root", "rep")).drop("root")
    largest = rest.groupBy("cluster", "comp").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"))
    rest = rest.join(largest, "cluster").withColumn("major", F.col("comp") == F.col("top")).withColumn("cls", F.floor(F.log(F.col("n")) / F.lit(-np.log(threshold)) + 1e-9).cast("int")).drop("top")
    rest = written(rest)
    count = written(rest.groupBy("cluster", "cls", "major").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    dealt = rest.join(count, ["cluster", "cls", "major"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sent = dealt.join(_block_pairs(count), ["cluster", "cls", "major", "block"]).select("rep", "key", "comp", "task", "side")
    need = sized(written(rest.select(F.col("rep").alias("doc_id")).distinct()))
    text = base.join(need, "doc_id", "left_semi")
    sent = sent.join(text.select(F.col("doc_id").alias("rep"), "text"), "rep")
    more = sent.groupBy("task").applyInArrow(_compare(k, num, den, threshold, miss), "a long, b long")
    roots = components(written(links.union(more)))

    root = reps.select("key", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    out = feats.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(root, "key", "left")
    component = F.coalesce("root", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return back(out, "doc_id", "component_id")
