"""Removal of repeated byte strings by suffix sorting.

A byte is removed if a string of `length` bytes that covers it also starts in a
document with a smaller id.

Equal strings must meet in one task without moving every suffix.  Each start gets
the minimum of the hashed 20-byte strings inside its `length` bytes; equal strings
have equal minima.  A run of starts with one minimum is a segment: its bytes are the
starts and length - 1 bytes of context.

1. Documents that equal an earlier one are set aside; they are removed whole.
2. Minima are shuffled as packed hashes; those of one document only are dropped.
3. Segments of the others are shuffled by their minimum.  Segments that repeat within
   a task (equal in 128 bits of a cryptographic hash) are sent once, with their smallest id.
   Segments of a minimum that very many documents hold would all meet in one task: they
   are cut into single starts, each sent by the hash of its whole string.
4. Each task sorts the suffixes of its segments in two stages: only suffixes smaller
   than their successors are sorted directly, the rest is induced by scanning the
   buckets of first bytes in order; adjacent common prefixes of `length` bytes then
   join equal strings, and the smallest id of each decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import sized, with_long_ids, written

GRAM = 20
#: Starts in a segment at most, and bytes of text for each group of segments.
RUN, GROUP_BYTES = 512, 4 << 20
#: A minimum of more documents than this, and than one in 2^HOT_BITS bytes of text, is hot: at most 2^HOT_BITS of them, 128 MB.
HOT, HOT_BITS = 20_000, 24
#: Digests of sent segments that a task remembers.
SEEN = 2_000_000
DIGEST = np.dtype([("x", np.uint64), ("y", np.uint64)])


def minima(raw: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash of a GRAM-byte string within each start's `length` bytes; starts cross texts here."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64)
    p, q = T.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T._VALUE[raw] * p[:n], out=total[1:])
    x = T.mix((total[GRAM:] - total[:-GRAM]) * q[: n + 1 - GRAM], 21)
    window, have = length - GRAM + 1, 1
    while have * 2 <= window:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < window:
        x = np.minimum(x[: len(x) - (window - have)], x[window - have :])
    return x


def segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each segment its text, first start, number of starts and minimum."""
    m = minima(raw, length)
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z, m
    start = np.arange(len(m))
    text = np.searchsorted(off, start, "right") - 1
    inside = start + length <= off[text + 1]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    bounds = np.flatnonzero(new | ~inside)
    last = np.concatenate((bounds, [len(m)]))[np.searchsorted(bounds, first, "right")]
    count = last - first
    if count.max() > RUN:
        pieces = -(-count // RUN)
        head = np.repeat(first, pieces)
        step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        count = np.minimum(np.repeat(count, pieces) - step, RUN)
        first = head + step
    return text[first], first, count, m[first]


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number."""
    n = max(0, len(raw) - 7)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | raw[j : j + n]
    return out


def sort_directly(w: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """`at` in the order of the `length` bytes that start there, eight bytes at a time; ties are sorted on."""
    key = w[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(at) else np.zeros(0, np.int64)
    for depth in range(8, length, 8):
        same = np.zeros(len(at), bool)
        equal = group[1:] == group[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        key = w[at[tied] + depth]
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key, g = key[order], group[tied]
        new = np.zeros(len(at), bool)
        new[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(new)
    return at


def two_stage_order(raw: np.ndarray, w: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The sorted places of `wanted` (a mask over `raw`) and of the successors they are induced from.

    `raw` ends in at least length + 8 zero bytes.  Order is right to `length` bytes.
    """
    n = len(raw)
    falls = np.zeros(n, bool)  # the suffix is larger than its successor
    step = np.sign(raw[:-1].astype(np.int16) - raw[1:])
    change = np.flatnonzero(step)
    nxt = np.searchsorted(change, np.arange(n - 1))
    ok = nxt < len(change)
    falls[:-1][ok] = step[change[nxt[ok]]] > 0
    need = wanted.copy()
    chain = np.flatnonzero(wanted & falls)
    while len(chain):
        chain = chain[chain + 1 < n] + 1
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[falls[chain]]
    direct = sort_directly(w, np.flatnonzero((need & ~falls)[: n - length - 7]), length)
    cut = np.searchsorted(raw[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[(raw[level] == c) & need[level] & falls[level]]
        bucket.append(direct[cut[c] : cut[c + 1]])
        here = np.concatenate(bucket)
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[need[before] & falls[before] & (raw[before] > c)]
        first = raw[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        if not len(first):
            continue
        edges = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for a, b in zip(edges, [*edges[1:], len(first)], strict=True):
            waiting[first[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(w: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's `length` bytes equal those of the place before it."""
    same = np.ones(max(0, len(at) - 1), bool)
    for depth in [*range(0, length - 7, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = w[at[left] + depth] == w[at[left + 1] + depth]
    return np.concatenate(([False], same)) if len(at) else same


def smallest_ids(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every start of the segments laid out in `raw`, the smallest id with the same `length` bytes, in order of place."""
    places = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    owner = np.repeat(ids, count)
    wanted = np.zeros(len(raw), bool)
    wanted[places] = True
    w = words8(raw)
    order = two_stage_order(raw, w, wanted, length)
    order = order[wanted[order]]
    run = np.cumsum(~common_prefixes(w, order, length)) - 1
    who = owner[np.searchsorted(places, order)]
    low = np.full(run[-1] + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, run, who)
    out = np.empty(len(places), np.int64)
    out[np.searchsorted(places, order)] = low[run]
    return out


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted ranges [from, to) without overlaps or touching ends."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ranges) - 1]))
    return np.stack((ranges[new, 0], reach[last]), axis=1)


_MINIMA = pa.schema([("part", pa.int32()), ("m", pa.binary()), ("row", pa.binary()), ("n", pa.binary()), ("ids", pa.binary()), ("ths", pa.binary())])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False), np.int64)


def _send_minima(length: int, parts: int):
    """Minima of documents by their part; of many documents of a batch the first and last stand for all.

    The documents between these two are known to share the minimum: rows with part -1 - k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for lo in range(0, len(whole), 16_000):
                batch = whole.slice(lo, 16_000)
                ids, ths = _column(batch, "doc_id"), _column(batch, "th")
                ms, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for a, _, raw, off in T.pieces(batch.column("text")):
                    text, _, _, m = segments(raw, off, length)
                    order = np.lexsort((text, m))
                    m, text = m[order], text[order]
                    new = np.ones(len(m), bool)
                    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
                    ms.append(m[new])
                    rows.append(text[new] + a)
                m, row = np.concatenate(ms), np.concatenate(rows).astype(np.uint16)
                order = np.lexsort((ids[row], m))
                m, row = m[order], row[order]
                head = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))) if len(m) else np.zeros(0, np.int64)
                size = np.diff(np.concatenate((head, [len(m)])))
                n, part = np.ones(len(m), np.uint16), (m % np.uint64(parts)).astype(np.int32)
                shared = (size > 2) & (ids[row[head]] < ids[row[head + size - 1]])
                n[head[shared]] = size[shared] - 1
                turn += 1
                between = np.repeat(shared, size)
                between[head[shared]] = between[(head + size - 1)[shared]] = False
                part[between] = -1 - turn % parts
                order = np.argsort(part, kind="stable")
                head = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0))) if len(m) else np.zeros(0, np.int64)
                for which in np.split(order, head[1:]) if len(m) else []:
                    used, at = np.unique(row[which], return_inverse=True)
                    cells = (part[which[0]], m[which].tobytes(), at.astype(np.uint16).tobytes(), n[which].tobytes(), ids[used].tobytes(), ths[used].tobytes())
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(cells, _MINIMA.types, strict=True)], schema=_MINIMA)

    return run


def _repeated_minima(limit: int):
    """(doc_id, th, minima) of the minima that stand in more than one document; those of more than `limit` also without a document."""

    def run(table: pa.Table) -> pa.Table:
        load = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        m, row, ids, ths = load("m", np.uint64), load("row", np.uint16), load("ids", np.int64), load("ths", np.int64)
        shift = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        at = np.concatenate([r.astype(np.int64) + s for r, s in zip(row, shift[:-1], strict=True)])
        m, ids, ths, n = np.concatenate(m), np.concatenate(ids), np.concatenate(ths), np.concatenate(load("n", np.uint16)).astype(np.int64)
        order = np.argsort(m, kind="stable")
        m, at, n = m[order], at[order], n[order]
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        group, head = np.cumsum(new) - 1, np.flatnonzero(new)
        low, high = np.minimum.reduceat(ids[at], head), np.maximum.reduceat(ids[at], head)
        hot = m[head][(np.add.reduceat(n, head) > limit) & (low < high)] if table.column("part")[0].as_py() >= 0 else m[:0]
        keep = (low < high)[group] | (table.column("part")[0].as_py() < 0)
        m, at = m[keep], at[keep]
        order = np.argsort(at, kind="stable")
        m, at = m[order], at[order]
        used, first = np.unique(at, return_index=True)
        blobs = [x.tobytes() for x in np.split(m, first[1:])] if len(used) else []
        found = pa.table({"doc_id": ids[used], "th": ths[used], "m": pa.array(blobs, pa.binary())})
        return pa.concat_tables((found, pa.table({"doc_id": pa.array([None], pa.int64()), "th": pa.array([None], pa.int64()), "m": pa.array([hot.tobytes()], pa.binary())}))) if len(hot) else found

    return run


def digests(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic hash of each run of bytes."""
    body = raw.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(body[b : b + n], digest_size=16).digest() for b, n in zip(begin.tolist(), size.tolist(), strict=True)), DIGEST)


def changes(key: np.ndarray) -> np.ndarray:
    """Where sorted digests differ from the one before."""
    return (key["x"][1:] != key["x"][:-1]) | (key["y"][1:] != key["y"][:-1])


_SEGMENTS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("ths", pa.binary()), ("start", pa.binary()), ("count", pa.binary()), ("bytes", pa.binary())])
_RANGES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("ranges", pa.binary())])


def _send_segments(length: int, parts: int, hot: np.ndarray):
    """Segments by their minimum's part; starts of the `hot` minima by the hash of their string.  Rows with part -1 - k are ranges already known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, seen_id = np.zeros(0, DIGEST), np.zeros(0, np.int64)  # segments already sent: rows come in order of id
        turn = 0
        for whole in batches:
            lows = []
            for lo in range(0, len(whole), 2_000):
                batch = whole.slice(lo, 2_000)
                ids, ths = _column(batch, "doc_id"), _column(batch, "th")
                known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for y in batch.column("ms").to_pylist() for x in y]))
                for a, _, raw, off in T.pieces(batch.column("text")):
                    text, first, count, m = segments(raw, off, length)
                    keep = np.isin(m, known)
                    text, first, count, m = text[keep], first[keep], count[keep], m[keep]
                    single = np.isin(m, hot)
                    size = np.where(single, count, 1)
                    first = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    text, m, single, count = np.repeat(text, size), np.repeat(m, size), np.repeat(single, size), np.repeat(np.where(single, 1, count), size)
                    key, doc = digests(raw, first, count + length - 1), ids[a + text]
                    m[single] = key["x"][single]
                    order = np.lexsort((first, doc, key["y"], key["x"]))
                    key, doc = key[order], doc[order]
                    head = np.ones(len(key), bool)
                    head[1:] = changes(key)
                    lead = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
                    if len(seen):
                        spot = np.minimum(np.searchsorted(seen["x"], key["x"]), len(seen) - 1)
                        same = (seen["x"][spot] == key["x"]) & (seen["y"][spot] == key["y"])
                        lead = np.where(same, np.minimum(lead, seen_id[spot]), lead)
                    lows.append((key[doc == lead], lead[doc == lead]))
                    gone, new, doc = order[doc > lead], order[doc == lead], ids[a + text]
                    part = (m[new] % np.uint64(parts)).astype(np.int64)
                    new = new[np.argsort(part, kind="stable")]
                    cut = np.searchsorted(np.sort(part), np.arange(parts + 1))
                    out = [(k, new[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut))]
                    if len(gone):
                        turn += 1
                        out.append((-1 - turn % parts, gone))
                    for k, which in out:
                        size = (count[which] + length - 1).astype(np.int64)
                        body = b""
                        if k >= 0:
                            at = np.repeat(first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
                            body = raw[at].tobytes()
                        cells = (k, doc[which].tobytes(), ths[a + text[which]].tobytes(), (first[which] - off[text[which]]).tobytes(), count[which].tobytes(), body)
                        yield pa.record_batch([pa.array([x], t) for x, t in zip(cells, _SEGMENTS.types, strict=True)], schema=_SEGMENTS)
            if len(seen) > SEEN:  # sent once more then; the receiver finds them equal
                seen, seen_id = seen[:0], seen_id[:0]
            key, doc = (np.concatenate((old, *(x[i] for x in lows))) for i, old in enumerate((seen, seen_id)))
            order = np.lexsort((doc, key["y"], key["x"]))
            key, doc = key[order], doc[order]
            head = np.concatenate(([True], changes(key))) if len(key) else np.zeros(0, bool)
            seen, seen_id = key[head], doc[head]

    return run


def _sort_segments(length: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        load = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()])
        ids, ths, start, count = load("ids"), load("ths"), load("start"), load("count")
        if part < 0:
            lo, hi, which = start, start + count + length - 1, np.arange(len(ids))
        else:
            raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            size = count + length - 1
            begin = np.cumsum(size) - size
            number: dict[bytes, int] = {}
            key = np.array([number.setdefault(raw[b : b + s].tobytes(), len(number)) for b, s in zip(begin.tolist(), size.tolist(), strict=True)], np.int64)
            # Equal segments are laid out once, under their smallest id.
            order = np.lexsort((ids, key))
            head = np.ones(len(key), bool)
            head[1:] = key[order][1:] != key[order][:-1]
            one = order[head]
            cls = np.empty(len(key), np.int64)
            cls[order] = np.cumsum(head) - 1
            at = np.repeat(begin[one] - np.cumsum(size[one]) + size[one], size[one]) + np.arange(size[one].sum())
            laid = np.concatenate((raw[at], np.zeros(length + 16, np.uint8)))
            low = smallest_ids(laid, np.cumsum(size[one]) - size[one], count[one], ids[one], length)
            cut = np.cumsum(count[one]) - count[one]
            place = np.repeat(cut[cls] - np.cumsum(count) + count, count) + np.arange(count.sum())
            which = np.repeat(np.arange(len(ids)), count)
            goes = low[place] < ids[which]
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            lo, which = at[goes], which[goes]
            hi = lo + length
        doc = np.lexsort((lo, ths[which], ids[which]))
        i, t = ids[which][doc], ths[which][doc]
        ranges = np.stack((lo[doc], hi[doc]), axis=1)
        head = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])))) if len(i) else np.zeros(0, np.int64)
        blobs = [merged(r).tobytes() for r in np.split(ranges, head[1:])] if len(head) else []
        return pa.table({"doc_id": i[head], "th": t[head], "ranges": pa.array(blobs, pa.binary())})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for i, text, whole, blobs in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").cast(pa.binary()), batch.column("whole").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
            body = text.as_py()
            ranges = np.array([[0, len(body)]]) if whole else np.concatenate([np.frombuffer(b, np.int64) for b in blobs or [b""]]).reshape(-1, 2)
            if len(ranges):
                ranges = merged(ranges)
            kept, at = hashlib.sha256(), 0
            for a, b in ranges.tolist():
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            rows.append((i, len(body), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), kept.hexdigest(), ranges.ravel()))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for each row of `docs`.

    Texts are UTF-8 bytes; null is empty.  A byte goes if a `length`-byte string over
    it also starts in a document with a smaller id; strings are judged on the input.
    `spans` are the removed runs, from and to in turn.  Rows of one id do not affect
    each other.  A row with a null id neither loses bytes nor makes others lose any.
    Ids are
    of any type that can be ordered.  Other columns are not used.  `length` is 28 or more.
    Minima of more than `hot` documents are split; results do not depend on it.
    """
    base, back = with_long_ids(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id")
    base = base.withColumn("th", F.xxhash64("text"))
    thin = base.where("doc_id is not null").select("doc_id", "th", F.md5("text").alias("key"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= length)
    first = thin.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n").alias("n"))
    first = written(first)
    total = first.agg(F.sum("n")).first()[0] or 0
    copies = sized(written(thin.join(first.where("low < high").select("key", "low"), "key").where("doc_id > low").select("doc_id", "th").distinct()))
    alone = base.where((F.col("doc_id").isNotNull()) & (F.octet_length("text") >= length)).join(copies, ["doc_id", "th"], "left_anti")
    parts = max(16, total // GROUP_BYTES)
    packed = alone.select("doc_id", "th", "text").mapInArrow(_send_minima(length, max(8, parts // 8)), "part int, m binary, row binary, n binary, ids binary, ths binary")
    repeated = packed.groupBy("part").applyInArrow(_repeated_minima(max(hot, total >> HOT_BITS)), "doc_id long, th long, m binary")
    repeated = written(repeated.groupBy("doc_id", "th").agg(F.collect_list("m").alias("ms")))  # at most one blob for each part and batch
    hot_minima = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for row in repeated.where("doc_id is null").toLocalIterator() for x in row["ms"])])
    repeated = repeated.where("doc_id is not null")
    need = sized(repeated.select("doc_id", "th"))
    text = alone.join(need, ["doc_id", "th"], "left_semi")
    sent = text.join(repeated, ["doc_id", "th"]).select("doc_id", "th", "text", "ms").sortWithinPartitions("doc_id").mapInArrow(_send_segments(length, parts, hot_minima), "part int, ids binary, ths binary, start binary, count binary, bytes binary")
    ranges = sent.groupBy("part").applyInArrow(_sort_segments(length), "doc_id long, th long, ranges binary")
    ranges = written(ranges.groupBy("doc_id", "th").agg(F.collect_list("ranges").alias("blobs")).select("doc_id", "th", F.lit(False).alias("whole"), "blobs"))
    gone = ranges.union(copies.select("doc_id", "th", F.lit(True).alias("whole"), F.array().cast("array<binary>").alias("blobs")))
    # Only texts that lose bytes meet their ranges; all others are hashed where they are.
    lost = sized(written(gone.select("doc_id", "th").distinct()))
    touched = base.join(lost, ["doc_id", "th"], "left_semi").join(gone, ["doc_id", "th"]).select("doc_id", "text", "whole", "blobs")
    touched = touched.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    same = base.join(lost, ["doc_id", "th"], "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast("array<bigint>").alias("spans"))
    return back(touched.union(same), "doc_id")
