"""Words, shingles and their hashes for whole Arrow text columns, as NumPy arrays.

Every function works on the UTF-8 buffer of a batch, so no Python string is made
for a word.  A word is a maximal run of bytes other than space, tab, LF, VT, FF
and CR; A-Z count as a-z.  A null text is an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; each needs about 40 bytes of memory.
PIECE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_FACTOR = mix(np.arange(1, 65, dtype=np.uint64), 7) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def repaired(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts whose bytes that are no UTF-8 became replacement characters."""
    inner = off[:-1][np.diff(off) > 0]
    try:
        if not ((raw[inner] & 0xC0) == 0x80).any():
            raw.tobytes().decode()
            return raw, off
    except UnicodeDecodeError:
        pass
    texts = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def strings(column: pa.Array) -> list[str | None]:
    """The texts of a column; bytes that are no UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    raw, off = utf8(column)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (n + 1 values)."""
    inside = ~_SPACE[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < len(raw))]
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


#: Longer words are hashed one by one.
LONG_WORD = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, the same wherever the word stands.

    A chain of mixing steps over the word's eight-byte chunks: unlike a sum of powers
    it has no words that collide by their form, so only chance (one in 2^64 for a pair)
    makes two words equal.
    """
    low = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    chunk = np.ndarray(len(raw) + 1, "<u8", low, 0, (1,))  # the eight bytes from each place on
    size = end - start
    out = mix(size.astype(np.uint64), 1)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero(size <= LONG_WORD)
    at, rest = start[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (chunk[at] & _KEEP[np.minimum(rest, 8)]), 6)
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return out


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text, and each text's first; shorter texts count as one run."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    at = first[text] + (np.arange(out[-1]) - out[text])
    size = np.minimum(n, k)[text]
    pad = np.concatenate((word, np.zeros(k, np.uint64)))
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += np.where(size > j, pad[np.minimum(at + j, len(pad) - 1)] * _FACTOR[j], np.uint64(0))
    return mix(total, 2) ^ size.astype(np.uint64), out


def distinct(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text."""
    return [np.unique(value[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
