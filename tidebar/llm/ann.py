"""Nearest vectors by largest inner product, with collision-counting hashing.

Vectors of one block are projected on random lines; each line keeps its values sorted.
A query opens a window about its own projection on every line, and a vector collides
with it on the lines whose windows hold the vector.  The windows' half width is the radius
R: of the vectors at most R away each collides on a line with a known probability (68 %),
so one that collides on fewer lines than a threshold is within R with a known
probability only.  Vectors that reach the threshold are verified.
R grows (virtual rehashing: windows only get wider) until the k-th best verified vector is
at most R away, or none is left.  Each vector knows its place on each line, so it is in a window if
its place is within the window's: collisions are counted by comparing small numbers.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), with M the
largest norm of the block; blocks hold vectors of about one norm.  Blocks of queries meet
blocks of vectors of the same length in tasks of bounded size, and the best of
each block are put together in two steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import sized, written

#: Lines; growth of the radius; the share of vectors within the radius that may stay below the threshold.
LINES, GROWTH, MISSED = 48, 1.2, 0.1
#: Vectors and queries of a task at most, on average.
BLOCK, QUERIES = 8192, 512
#: Blocks whose results meet in one task.
MERGED = 64


def least_collisions(lines: int = LINES, missed: float = MISSED) -> int:
    """The largest threshold that a vector at the radius reaches with probability 1 - missed."""
    p = math.erf(1 / math.sqrt(2))
    below, chance = 0.0, []
    for k in range(lines + 1):
        chance.append(below)
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
    return max(k for k, c in enumerate(chance) if c <= missed)


def directions(width: int, lines: int = LINES) -> np.ndarray:
    """Fixed Gaussian directions, made of counters: the same for every task."""
    at = np.arange(width * lines, dtype=np.uint64)
    u = (T.mix(at, 11) >> np.uint64(11)).astype(float) / (1 << 53)
    v = (T.mix(at, 12) >> np.uint64(11)).astype(float) / (1 << 53)
    return (np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)).reshape(width, lines)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, added from the first component on: the same for equal rows wherever they stand."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += x[:, j] * q[j]
    return out


class Index:
    """The sorted projections of a block."""

    def __init__(self, x: np.ndarray, lines: int = LINES, least: int | None = None):
        self.x = x
        self.unit = x / np.abs(x).max()
        size = np.einsum("ij,ij->i", self.unit, self.unit)
        self.most = math.sqrt(float(size.max()))
        last = np.sqrt(np.maximum(self.most**2 - size, 0.0))
        self.lines = directions(x.shape[1] + 1, lines)
        p = self.unit @ self.lines[:-1] + last[:, None] * self.lines[-1]
        order = np.argsort(p, axis=0, kind="stable").T
        self.values = np.take_along_axis(p, order.T, axis=0).T.copy()
        # Of each vector, its place among the values of each line.
        self.places = np.empty(order.shape, np.uint16 if len(x) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(x), dtype=self.places.dtype)[None], axis=1)
        # Rooms that all searches use.
        self.within, self.hit = np.empty_like(self.places), np.empty(order.shape, bool)
        self.least = least_collisions(lines) if least is None else least
        # No two vectors are farther apart than 2 M; the last window holds all.
        steps = math.ceil(math.log(5, GROWTH))
        self.radii = np.r_[self.most / 2 * GROWTH ** np.arange(steps + 1), np.inf]

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places of the windows of each query, radius and line, and those after their last."""
        top = np.abs(queries).max(axis=1, keepdims=True)
        unit = queries / top
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) * self.most
        at = unit @ self.lines[:-1]
        low, high = (np.empty((len(queries), len(self.radii), len(self.values)), self.places.dtype) for _ in range(2))
        for i, v in enumerate(self.values):
            low[:, :, i] = np.searchsorted(v, at[:, i, None] - self.radii, "left")
            high[:, :, i] = np.searchsorted(v, at[:, i, None] + self.radii, "right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each vector, the number of lines whose window holds it."""
        # Places before the window wrap around to large numbers.
        np.less(np.subtract(self.places, low[:, None], out=self.within), (high - low)[:, None], out=self.hit)
        return self.hit.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(self.hit) < 256 else np.int64)

    def search(self, q: np.ndarray, own: int, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, number verified) of about the k best rows and all that tie with the last of them; `own` is left out (-1: none)."""
        n = len(self.x)
        left = n - (own >= 0)
        want = min(k, left)
        if not want:
            return np.zeros(0, np.int64), np.zeros(0), 0
        lows, highs = (w[0] for w in self.windows(q[None])) if windows is None else windows
        unit = q / np.abs(q).max()
        unit = unit / np.linalg.norm(unit) * self.most
        done, score = np.zeros(n, bool), np.full(n, -np.inf)
        if own >= 0:
            done[own] = True
        verified = 0
        for radius, low, high in zip(self.radii.tolist(), lows, highs, strict=True):
            ready = np.flatnonzero((self.collisions(low, high) >= self.least) & ~done)
            if len(ready):
                done[ready] = True
                score[ready] = self.unit[ready] @ unit
                verified += len(ready)
            # The k-th best is at most the radius away.
            if verified == left or verified >= want and np.count_nonzero(score >= self.most**2 - radius**2 / 2) >= want:
                break
        worst = np.partition(score, n - want)[n - want]
        some = np.flatnonzero(score >= worst - 1e-9 * self.most**2)
        return some, products(self.x[some], q), verified


def _rows(column: pa.Array) -> list[bytes | None]:
    """Doubles as bytes; None where a vector is null, empty or zero or has a null or non-finite component."""
    out: list[bytes | None] = []
    for v in column:
        x = v.values if v.is_valid else None
        ok = x is not None and len(x) and not x.null_count
        if ok:
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = np.isfinite(x).all() and x.any()
        out.append(x.tobytes() if ok else None)
    return out


def _prepare(batches):
    """(row, vec_id, vec, size, octave) of the usable vectors; the octave is their norm's power of two."""
    for batch in batches:
        vec = _rows(batch.column(2))
        size = [len(v) // 8 if v else None for v in vec]
        octave = []
        for v in vec:
            x = np.frombuffer(v) if v else np.ones(1)
            top = float(np.abs(x).max())
            octave.append(round(math.log2(top) + math.log2(float(np.linalg.norm(x / top)))))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vec, pa.binary()), pa.array(size, pa.int32()), pa.array(octave, pa.int32())], names=["row", "vec_id", "vec", "size", "octave"])


FOUND = "row long, part int, found array<struct<worse:double,no_id:boolean,vec_id:bigint>>"
_FOUND = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("found", pa.list_(pa.struct([("worse", pa.float64()), ("no_id", pa.bool_()), ("vec_id", pa.int64())])))])


def _search(k: int):
    """The k best of a block for each query of a task."""

    def run(table: pa.Table) -> pa.Table:
        raw, row, ids = table.column("vec").to_pylist(), table.column("row").to_numpy(), table.column("vec_id").to_pylist()
        asks = table.column("asks").to_numpy()
        own, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[dict] = []
        if len(own) and len(asked):
            index = Index(np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), -1))
            place = {int(row[i]): j for j, i in enumerate(own)}
            order = np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in own], np.int64)
            part = table.column("block")[0].as_py() % MERGED
            queries = np.frombuffer(b"".join(raw[i] for i in asked)).reshape(len(asked), -1)
            for i, q, low, high in zip(asked, queries, *index.windows(queries), strict=True):
                some, score, _ = index.search(q, place.get(int(row[i]), -1), k, (low, high))
                best = np.lexsort((order[some], -score))[:k]
                found = [{"worse": -s, "no_id": ids[own[j]] is None, "vec_id": ids[own[j]]} for s, j in zip(score[best].tolist(), some[best].tolist(), strict=True)]
                out.append({"row": int(row[i]), "part": part, "found": found})
        return pa.Table.from_pylist(out, schema=_FOUND)

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k rows of largest inner product but itself.

    Scores are inner products of the vectors in double precision.  Vectors that are null,
    empty or zero or hold a null or non-finite component take no part; vectors of different
    length have no product and do not meet.  Rows are told apart as rows: those that repeat
    an id are candidates (and queries) each.  Ties go to the smaller id; a null id is
    a candidate after all others and no query.  Products beyond the range of doubles are
    infinite.  Other columns are not used; an empty table gives an empty one.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col))
    base = written(rows.mapInArrow(_prepare, "row long, vec_id long, vec binary, size int, octave int").where("vec is not null"))
    queries = base.where(F.pmod("vec_id", F.lit(every)) == 0)
    kinds = base.groupBy("size", "octave").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    turns = queries.groupBy("size").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    kinds = sized(written(kinds.join(turns, "size")))
    # A task is a block of vectors of one size and octave and a turn of queries of that size.
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    own = base.join(kinds, ["size", "octave"]).withColumn("block", deal("blocks")).withColumn("turn", spread("turns"))
    asked = queries.drop("octave").join(kinds, "size").withColumn("turn", deal("turns")).withColumn("block", spread("blocks"))
    columns = ["size", "octave", "block", "turn", "row", "vec_id", "vec"]
    both = own.select(*columns, F.lit(False).alias("asks")).union(asked.select(*columns, F.lit(True)))
    both = both.withColumn("task", F.xxhash64("size", "octave", "block", "turn"))
    found = both.select("task", "block", "row", "vec_id", "vec", "asks").groupBy("task").applyInArrow(_search(k), FOUND)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    merged = found.groupBy("row", "part").agg(best).groupBy("row").agg(best)
    out = merged.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.worse")).alias("score"))
