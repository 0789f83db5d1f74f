"""Vector code compression: product quantisation with exact nearest entries by slices and bit masks.

A vector of integers is cut into four parts; each part is replaced by the index of the
nearest of 256 entries of its codebook.  The nearest entry is found without comparing
with all: in each dimension the entries' coordinates are sorted, and for each place in
that order a mask of 256 bits (four uint64) tells the entries before it.  A radius about
a part's coordinate is a range of that order, and the range's mask is the exclusive or of
two prefix masks; the masks of all dimensions ANDed are the entries inside a box.
Whatever is at most the radius away is inside, so once the best of the box is at
most the radius away it is the nearest of all.  The radius starts small and is raised to
the best distance found (or doubled where the box is empty).

A round of fitting sends the codebooks (a fixed size) to the tasks and gets sums by part
and entry back, which are added up before they reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import sized, written

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: Parts that are searched at once in a task.
BLOCK = 512


def most_value(width: int) -> int:
    """The largest component that leaves a part of `width` components a squared distance below 2^61."""
    return int(math.isqrt((1 << 61) // (4 * max(1, width))))


class Slices:
    """The masks of one codebook: (entries, width) integers."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, width = book.shape
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, axis=0).T.copy()
        words = -(-max(n, 1) // 64)
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        # masks[d, k]: the first k entries in the order of dimension d.
        self.masks = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            self.masks[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        # An entry's distance to its nearest other one, at the median: where a search starts.
        near = [np.partition(((book - e) ** 2).sum(axis=1), 1)[1] for e in book] if n > 1 else [0]
        self.start = max(1, math.isqrt(int(np.median(near))) // 2)

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row the entries of the box with this radius, as a table of truth values."""
        out = None
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            here = self.masks[d][high] ^ self.masks[d][low]
            out = here if out is None else out & here
        bits = np.unpackbits(out.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        return bits[:, : len(self.book)].view(bool)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; of equally near ones the first."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            index[a : a + BLOCK], best[a : a + BLOCK] = self._nearest(x[a : a + BLOCK])
        return index, best

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        seen = np.zeros((len(x), len(self.book)), bool)
        radius, todo = np.full(len(x), self.start, np.int64), np.arange(len(x))
        while len(todo):
            box = self.inside(x[todo], radius[todo]) & ~seen[todo]
            seen[todo] |= box
            row, entry = np.nonzero(box)
            if len(row):
                apart = x[todo[row]] - self.book[entry]
                apart = np.einsum("ij,ij->i", apart, apart)
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                low = np.minimum.reduceat(apart, first)
                # The first entry that has the row's lowest distance.
                hit = np.flatnonzero(apart == np.repeat(low, np.diff(np.r_[first, len(row)])))
                lead = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
                who, entry, apart = todo[row[lead]], entry[lead], apart[lead]
                better = (apart < best[who]) | ((apart == best[who]) & (entry < index[who]))
                index[who[better]], best[who[better]] = entry[better], apart[better]
            found = best[todo] < np.iinfo(np.int64).max
            root = np.zeros(len(todo), np.int64)
            root[found] = [math.isqrt(int(b) - 1) + 1 if b else 0 for b in best[todo][found]]
            open_ = ~found | (root > radius[todo])
            radius[todo] = np.where(found, root, radius[todo] * 2)
            todo = todo[open_]
        return index, best


def _whole(width: int):
    """Integer components of each vector, zeros after the end up to `width`; null where the vector is null or has a null or non-finite component."""
    most = most_value(width // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch.column(1):
                x = v.values if v.is_valid else None
                if x is None or x.null_count or not np.isfinite(x := x.to_numpy(zero_copy_only=False).astype(np.float64)).all():
                    out.append(None)
                    continue
                row = np.zeros(width, np.int64)
                row[: len(x)] = np.clip(np.floor(np.clip(x, -most, most) * SCALE), -most, most)
                out.append(row.tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _sums(books: np.ndarray):
    """(part, entry, n, sums) of the vectors of a task: at most one row for each part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                index, _ = slices[p].nearest(x[:, p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, x[:, p])
        part, entry = np.nonzero(n)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            found = [slices[p].nearest(x[:, p]) for p in range(parts)]
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fitted(rows: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of rows (vec_id, v): those of the smallest ids, moved `rounds` times to the floor of their parts' means."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.frombuffer(b"".join(bytes(r[0]) for r in first), np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    if not len(first):
        return books
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        total = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in total.collect():  # as many rows as the codebooks have components
            books[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that is not null and has finite components only.

    Components x count as floor(1024 x), cut off where squared distances would not fit in
    a long (at 190 million for parts of 16 components).  Vectors shorter than the longest, or
    whose length is no multiple of four, are filled up with zeros.  Repeated rows are coded
    each; of equal ids among the first 256 the smaller vector by its bytes comes first, and null ids come last.
    With fewer vectors than entries there are fewer entries.  label_error sums the errors of
    equal labels (nulls are one label), null where that does not fit in a long.  Other
    columns are not used; an empty table gives an empty one.
    """
    longest = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(PARTS, -(-max(longest, 0) // PARTS) * PARTS)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = written(rows.mapInArrow(_whole(width), "vec_id long, label string, v binary").where("v is not null"))
    books = fitted(rows, width)
    coded = written(rows.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"))
    by_label = sized(written(coded.groupBy(F.col("label").alias("__l")).agg(F.try_sum("error").alias("label_error"))))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
