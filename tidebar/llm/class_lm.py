"""Brown class-based bigram language model.

Tokens are lower-cased words and one end for each text.  The model is
P(class | class before) * P(word | class).  Classes come from exchange clustering:
units are moved to the class that raises the likelihood of the class bigrams most,
until few units move.  A unit is a word that occurs MIN_COUNT times or more, or all rarer
words with the same ending, so that every word of the corpus, seen or not, has a class.
The end is a class of its own.  Units grow with the corpus, without bound.

Counts, statistics and bigrams cover all training rows and are gathered by Spark:
1. word counts (grouped sums, combined in each task first), and the texts as unit numbers;
2. exchange clustering of the WORD_UNITS most frequent words and the endings on their
   bigrams: where all other words start from, in the class of their ending;
3. sweeps over all units: how often each stands before and after each class is summed
   by unit, and tasks choose each unit's best class against the table of class bigrams.
   A sweep counts only if it raises the likelihood of the class bigrams;
4. one pass for the scores, and one shuffle of the words that are not at hand by hash
   for their counts.

The most frequent units, LOCAL_WORDS at most, are at hand in every task, with count, unit
and class.  The others stay a table by word hash, which the words of each slice of texts
are joined with to get their classes, and whose sweeps are grouped by word; none of it
passes through the driver.  Where a word is looked up does not change the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import discard, written

#: A word that occurs so often in the training rows is a unit of its own.
MIN_COUNT = 5
#: So many units at most are sent to tasks (21 bytes each); the others are joined.  Memory alone depends on it.
LOCAL_WORDS = 1 << 22
#: Where clustering starts: frequent words, word endings, classes and sweeps; then sweeps over all units.
WORD_UNITS, ENDINGS, CLASSES, SWEEPS, ALL_SWEEPS = 1024, 511, 96, 8, 2
UNITS = WORD_UNITS + ENDINGS + 1
#: Added to every word's count, and the share of the class's own frequency in its transitions.
ADD, PRIOR = 0.1, 4.0


def endings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below ENDINGS from the last four bytes of each lower-cased word."""
    low = np.concatenate((np.zeros(4, np.uint8), T._LOWER[raw]))
    total = np.zeros(len(start), np.uint64)
    for j in range(1, 5):
        total = total * np.uint64(257) + np.where(end - j >= start, low[end - j + 4], 0).astype(np.uint64)
    return (T.mix(total, 9) % np.uint64(ENDINGS)).astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, row after the last, word hashes, endings, and each row's first word."""
    for a, b, raw, off in T.pieces(column):
        start, end, first = T.words(raw, off)
        yield a, b, T.word_hashes(raw, start, end), endings(raw, start, end), first


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, count) of the training rows of a batch."""
    for batch in batches:
        train = _flags(batch.column("train"))
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b, h, e, first in _tokens(batch.column("text")):
            keep = np.repeat(train[a:b], np.diff(first))
            h, at, n = np.unique(h[keep], return_index=True, return_counts=True)
            parts.append((h, e[keep][at], n))
        h, e, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at, which = np.unique(h, return_index=True, return_inverse=True)
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(e[at]), pa.array(np.bincount(which, weights=n, minlength=len(h)).astype(np.int64))], names=["word", "ending", "n"])


class Frequent:
    """Sorted hashes of the words at hand, their counts and units; units from len(word) on are endings, then the end."""

    def __init__(self, word: np.ndarray, count: np.ndarray, unit: np.ndarray):
        order = np.argsort(word)
        self.word, self.count, self.unit = word[order], count[order], unit[order].astype(np.uint32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does."""
        if not len(self.word):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return at, self.word[at] == h

    def units(self, h: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = (len(self.word) + e).astype(np.uint32)
        if len(self.word):
            at, known = self.find(h)
            out = np.where(known, self.unit[at], out)
        return out


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The rows' values with one `end` after each row."""
    return np.insert(values, first[1:], end)


def _slices(frequent: Frequent, joined: bool):
    """Texts as slices of unit numbers, 32 bits each, with the ends; training rows apart from the others.

    If words are `joined`, those not at hand are numbered within their slice, after all units, and
    their hashes and endings stand beside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        last = len(frequent.word) + ENDINGS
        for batch in batches:
            train = _flags(batch.column("train"))
            for a, b, h, e, first in _tokens(batch.column("text")):
                size = np.diff(first)
                unit = frequent.units(h, e)
                for flag in (True, False):
                    rows = np.flatnonzero(train[a:b] == flag)
                    if not len(rows):
                        continue
                    number += 1
                    mine = np.repeat(train[a:b] == flag, size)
                    own, words, ending = unit[mine], np.zeros(0, np.uint64), np.zeros(0, np.uint16)
                    if joined:
                        far = own >= len(frequent.word)
                        words, at, which = np.unique(h[mine][far], return_index=True, return_inverse=True)
                        ending = e[mine][far][at].astype(np.uint16)
                        own[far] = last + 1 + which
                    start = np.concatenate(([0], np.cumsum(size[rows])))
                    own = with_ends(own, start, last).astype(np.uint32)
                    ids, ths = (batch.column(c).take(pa.array(rows + a)) for c in ("doc_id", "th"))
                    cells = [pa.array([x.tobytes()], pa.binary()) for x in (own, start + np.arange(len(start)), words, ending)]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), x) for x in (ids, ths)]
                    yield pa.record_batch([pa.array([number]), pa.array([flag]), *cells, *lists], names=["slice", "train", "units", "first", "words", "endings", "doc_id", "th"])

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, word) of all words that are not at hand."""
    for batch in batches:
        for number, words in zip(batch.column("slice").to_pylist(), batch.column("words"), strict=True):
            words = np.frombuffer(words.as_py(), np.int64)
            yield pa.record_batch([pa.array(np.full(len(words), number)), pa.array(words)], names=["slice", "word"])


def with_classes(slices: DataFrame, known: DataFrame | None, rest: DataFrame | None) -> DataFrame:
    """Slices with the joined units among their words and the classes of these; `known` has (slice, word), `rest` (word, cls)."""
    if rest is None:
        return slices.select("*", F.lit(None).cast("array<bigint>").alias("rest_word"), F.lit(None).cast("array<int>").alias("rest_cls"))
    found = known.join(rest.select("word", "cls"), "word").groupBy("slice").agg(F.collect_list(F.struct("word", "cls")).alias("r"))
    return slices.join(found.select("slice", F.col("r")["word"].alias("rest_word"), F.col("r")["cls"].alias("rest_cls")), "slice", "left")


class Slice:
    """A slice read back: unit numbers, and for the words numbered after all units their hash, class and unit (-1: joined)."""

    def __init__(self, row: dict, cls: np.ndarray):
        self.cls, self.last = cls, len(cls) - 1
        self.codes = np.frombuffer(row["units"].as_buffer(), np.uint32)
        self.words = np.frombuffer(row["words"].as_py(), np.uint64)
        self.own = self.last - ENDINGS + np.frombuffer(row["endings"].as_py(), np.uint16).astype(np.int64)
        self.own_cls = cls[self.own].astype(np.int64)
        if row["rest_word"].is_valid and len(row["rest_word"]):
            at = np.searchsorted(self.words, row["rest_word"].values.to_numpy().view(np.uint64))
            self.own[at] = -1
            self.own_cls[at] = row["rest_cls"].values.to_numpy()

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.cls[np.minimum(codes, self.last)].astype(np.int64)
        far = codes > self.last
        out[far] = self.own_cls[codes[far].astype(np.int64) - self.last - 1]
        return out

    def units(self, codes: np.ndarray) -> np.ndarray:
        """Unit numbers; below 0 (-1 less the place in `words`) for joined ones."""
        out = codes.astype(np.int64)
        far = codes > self.last
        place = out[far] - self.last - 1
        out[far] = np.where(self.own[place] < 0, -1 - place, self.own[place])
        return out

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(code before, code) of all tokens, about a million at once."""
        before = self.last
        for lo in range(0, len(self.codes), 1 << 20):
            part = self.codes[lo : lo + (1 << 20)]
            yield np.concatenate((np.array([before], np.uint32), part[:-1])), part
            before = part[-1]


def _read_slices(batches: Iterator[pa.RecordBatch], cls: np.ndarray, columns: tuple = ()) -> Iterator[tuple]:
    names = ("units", "words", "endings", "rest_word", "rest_cls", *columns)
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in names}
            yield (Slice(row, cls), *(row[c] for c in columns))


def planes(x: np.ndarray) -> bytes:
    """The array byte by byte: first bytes first, which Spark's compression makes small."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


PACKED = "part int, code binary, n binary"
#: Distinct counts that a task holds before it hands them on.
HELD = 3_000_000


def _packed_counts(slices: Iterator[Slice], codes_of, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of the codes key * width + rest that `codes_of` makes of a slice's runs, packed by key modulo parts."""

    def pack(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = code // width
        part, local = (key % parts).astype(np.int32), key // parts * width + code % width
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            which = order[cut[p] : cut[p + 1]]
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([planes(np.diff(local[which], prepend=0))], pa.binary()), pa.array([planes(n[which])], pa.binary())], names=["part", "code", "n"])

    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for made in (codes for x in slices for codes in codes_of(x)):
        if isinstance(made, pa.RecordBatch):  # counts of joined words, packed already
            yield made
            continue
        new, m = np.unique(made, return_counts=True)
        code, which = np.unique(np.concatenate((code, new)), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate((n, m)), minlength=len(code)).astype(np.int64)
        if len(code) > HELD:
            yield from pack(code, n)
            code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield from pack(code, n)


def _dense(table: pa.Table, keys: int, width: int, parts: int) -> tuple[int, np.ndarray]:
    """The part, and the summed counts of its keys (part, part + parts, ...) as a table of `width` columns."""
    part = table.column("part")[0].as_py()
    out = np.zeros(len(range(part, keys, parts)) * width)
    for code, n in zip(table.column("code"), table.column("n"), strict=True):
        out[np.cumsum(unplanes(code.as_py(), np.int64))] += unplanes(n.as_py(), np.int64)
    return part, out.reshape(-1, width)


def _core_bigrams(core: np.ndarray, parts: int):
    """Bigrams of the core's units (numbers in `core` by unit), as packed counts and as dense parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes(x: Slice) -> Iterator[np.ndarray]:
            for before, code in x.runs():
                yield core[x.units(before)].astype(np.int64) * UNITS + core[x.units(code)]

        none = np.zeros(len(core), np.uint8)
        return _packed_counts((x for x, in _read_slices(batches, none)), codes, UNITS, parts)

    def total(table: pa.Table) -> pa.Table:
        part, out = _dense(table, UNITS, UNITS, parts)
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([out.tobytes()], pa.binary())})

    return count, total


def _class_bigrams(cls: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for x, in _read_slices(batches, cls):
            for before, code in x.runs():
                total += np.bincount(x.classes(before) * CLASSES + x.classes(code), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return run


#: Joined words whose counts before and after classes a task lays out at once.
AT_ONCE = 20_000


def _moves(cls: np.ndarray, step: np.ndarray, class_n: np.ndarray, parts: int):
    """Counts of (unit, class before or after), and from them each unit's best class where it is another.

    Units at hand have parts from 0 on; joined words have parts below 0, by their hash.
    """
    width = 2 * CLASSES

    def joined(x: Slice, place: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, n = np.unique(place * width + side, return_counts=True)
        place, side = code // width, code % width
        part = (x.words[place] % np.uint64(parts)).astype(np.int64)
        side = side + x.own_cls[place] * width
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            which = order[cut[p] : cut[p + 1]]
            cells = np.stack((x.words[place[which]].view(np.int64), side[which]))
            yield pa.record_batch([pa.array([-1 - p], pa.int32()), pa.array([cells.tobytes()], pa.binary()), pa.array([n[which].astype(np.int64).tobytes()], pa.binary())], names=["part", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes(x: Slice) -> Iterator[np.ndarray | pa.RecordBatch]:
            for before, code in x.runs():
                u = np.concatenate((x.units(code), x.units(before)))
                side = np.concatenate((x.classes(before), CLASSES + x.classes(code)))
                near = (u >= 0) & (u < len(cls) - 1)  # the end does not move
                yield u[near] * width + side[near]
                if (u < 0).any():
                    yield from joined(x, -1 - u[u < 0], side[u < 0])

        return _packed_counts((x for x, in _read_slices(batches, cls)), codes, width, parts)

    def best_of(out: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = out[:, :CLASSES], out[:, CLASSES:]
        gain = left @ step + right @ step.T - left.sum(axis=1, keepdims=True) * np.log10(np.maximum(class_n, 1.0))
        gain = np.round(gain, 7)  # products of other shapes differ in their last digits
        gain[:, class_n == 0] = -np.inf
        gain[:, -1] = -np.inf
        best = gain.argmax(axis=1)
        rows = np.arange(len(old))
        return best.astype(np.uint8), gain[rows, best] > gain[rows, old] + 1e-9

    def choose(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= 0:
            part, out = _dense(table, len(cls) - 1, width, parts)
            unit = np.arange(part, len(cls) - 1, parts)
            best, move = best_of(out, cls[unit].astype(np.int64))
            found = [(unit[move].astype(np.uint64), best[move])]
        else:
            part, found = -1, []
            word, code = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("code").to_pylist()], axis=1)
            n = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()])
            order = np.argsort(word)
            word, code, n = word[order], code[order], n[order]
            one, at, which = np.unique(word, return_index=True, return_inverse=True)
            for lo in range(0, len(one), AT_ONCE):
                hi = min(lo + AT_ONCE, len(one))
                a, b = at[lo], at[hi] if hi < len(one) else len(word)
                out = np.bincount((which[a:b] - lo) * width + code[a:b] % width, weights=n[a:b], minlength=(hi - lo) * width).reshape(-1, width)
                best, move = best_of(out, code[at[lo:hi]] // width)
                found.append((one[lo:hi][move].view(np.uint64), best[move]))
        unit, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"part": pa.array([part], pa.int32()), "unit": pa.array([unit.tobytes()], pa.binary()), "cls": pa.array([best.tobytes()], pa.binary())})

    return count, choose


def _joined_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, best class, a number below 4 by which half or a quarter of the words is told)."""
    for batch in batches:
        for unit, best in zip(batch.column("unit").to_pylist(), batch.column("cls").to_pylist(), strict=True):
            word = np.frombuffer(unit, np.uint64)
            best = np.frombuffer(best, np.uint8)
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(best.astype(np.int32)), pa.array((T.mix(word, 5) % np.uint64(4)).astype(np.int32))], names=["word", "best", "pick"])


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit for a square table of bigram counts; the last unit stays alone in the last class.

    Classes start from the units' ranks.  A sweep takes each unit, heaviest first,
    out of its class and puts it where sum n log n over class bigrams, less that of
    the classes' own counts twice, becomes largest (ties: the lowest class).
    """
    units = len(counts)
    weight = counts.sum(axis=1) + counts.sum(axis=0)
    order = np.argsort(-weight[:-1], kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(units - 1) % (classes - 1)
    cls[-1] = classes - 1
    member = np.zeros((units, classes))
    member[np.arange(units), cls] = 1
    table = member.T @ counts @ member
    free = np.arange(classes - 1)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if weight[u] == 0:
                continue
            own, old = counts[u, u], cls[u]
            row = np.bincount(cls, weights=counts[u], minlength=classes)
            col = np.bincount(cls, weights=counts[:, u], minlength=classes)
            row[old] -= own
            col[old] -= own
            table[old] -= row
            table[:, old] -= col
            table[old, old] -= own
            before, after = table.sum(axis=1), table.sum(axis=0)
            gain = (_gain(table + row) - _gain(table)).sum(axis=1) + (_gain(table.T + col) - _gain(table.T)).sum(axis=1)
            diagonal = table[free, free]
            gain = gain[free] + _gain(diagonal + row[free] + col[free] + own) - _gain(diagonal + row[free]) - _gain(diagonal + col[free]) + _gain(diagonal)
            out, into = row.sum() + own, col.sum() + own
            gain -= _gain(before[free] + out) - _gain(before[free]) + _gain(after[free] + into) - _gain(after[free])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            cls[u] = new
            table[new] += row
            table[:, new] += col
            table[new, new] += own
            moved += new != old
        if moved <= units // 200:
            break
    return cls


def transitions(table: np.ndarray) -> np.ndarray:
    """Logarithms of the shares of class bigrams, smoothed."""
    class_n = table.sum(axis=0)
    share = (class_n + 1.0) / (class_n.sum() + CLASSES)
    return np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))


def learn_classes(slices: DataFrame, core: np.ndarray, keys: np.ndarray, n_words: int, known: DataFrame | None, rest: DataFrame | None) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The class of each unit at hand, the table of class bigrams, and `rest` (word, ending) with the classes of the joined words.

    `core` has each unit's number in the core, `keys` a number that does not depend on where it is looked up.
    """
    slices = slices.select("slice", "units", "words", "endings")
    count, total = _core_bigrams(core, 8)
    counts = np.zeros((UNITS, UNITS))
    got = with_classes(slices, None, None).mapInArrow(count, PACKED).groupBy("part").applyInArrow(total, "part int, n binary").toArrow()
    for part, n in zip(got.column("part").to_pylist(), got.column("n").to_pylist(), strict=True):
        counts[part::8] = np.frombuffer(n).reshape(-1, UNITS)
    of_core = exchange(counts)
    cls = of_core[core].astype(np.uint8)
    if rest is not None:
        start = F.array(*(F.lit(int(c)) for c in of_core[WORD_UNITS : WORD_UNITS + ENDINGS]))
        rest = written(rest.select("word", F.get(start, F.col("ending").cast("int")).alias("cls")))

    def tabled(cls: np.ndarray, rest: DataFrame | None) -> tuple[np.ndarray, float]:
        got = with_classes(slices, known, rest).mapInArrow(_class_bigrams(cls), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(CLASSES * CLASSES)
        table[got.column("code").to_numpy()] = got.column("n").to_numpy()
        table = table.reshape(CLASSES, CLASSES)
        return table, _gain(table).sum() - _gain(table.sum(axis=0)).sum() - _gain(table.sum(axis=1)).sum()

    table, value = tabled(cls, rest)
    parts = max(8, math.ceil(n_words / 6_000_000))
    for _ in range(ALL_SWEEPS):
        count, choose = _moves(cls, transitions(table), table.sum(axis=0), parts)
        got = written(with_classes(slices, known, rest).mapInArrow(count, PACKED).groupBy("part").applyInArrow(choose, "part int, unit binary, cls binary"))
        near = got.where("part >= 0").toArrow()
        unit = np.frombuffer(b"".join(near.column("unit").to_pylist()), np.uint64).astype(np.int64)
        best = np.frombuffer(b"".join(near.column("cls").to_pylist()), np.uint8)
        pick = T.mix(keys[unit], 5) % np.uint64(4)
        # All units move at once: if that overshoots, a half or a quarter of them does.
        for share in (1, 2, 4):
            chosen = pick % np.uint64(share) == 0
            moved, new_rest = cls.copy(), None
            moved[unit[chosen]] = best[chosen]
            if rest is not None:
                moves = got.where("part < 0").select("unit", "cls").mapInArrow(_joined_moves, "word long, best int, pick int")
                new_rest = written(rest.join(moves.where(F.col("pick") % share == 0), "word", "left").select("word", F.coalesce("best", "cls").alias("cls")))
            new_table, new_value = tabled(moved, new_rest)
            if new_value > value:
                break
            discard(new_rest)
        else:
            break
        discard(rest)
        cls, rest, table, value = moved, new_rest, new_table, new_value
    return cls, table, rest


def _score(count: np.ndarray, cls: np.ndarray, step: np.ndarray, emit: np.ndarray):
    """One row for each text: n_tokens, and what needs no count of words that are not at hand; `count` is by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_count = np.concatenate((np.log10(count + ADD), [0.0]))
        for x, train, first, ids, ths in _read_slices(batches, cls, ("train", "first", "doc_id", "th")):
            first = np.frombuffer(first.as_py(), np.int64)
            size, start = np.diff(first), first[:-1]
            known, log, path = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
            done = 0
            for before, code in x.runs():
                # A run's rows: those from that of its first token to that of its last one.
                lo, hi = (int(np.searchsorted(first, p, "right")) - 1 for p in (done, done + len(code) - 1))
                cut = np.maximum(start[lo : hi + 1] - done, 0)
                k, k_before = x.classes(code), x.classes(before)
                path[lo : hi + 1] += np.add.reduceat(step[k_before, k] - emit[k], cut)
                known[lo : hi + 1] += np.add.reduceat((code < len(count)).astype(np.int64), cut)
                log[lo : hi + 1] += np.add.reduceat(log_count[np.minimum(code, len(count))], cut)
                done += len(code)
            columns = [ids.values, pa.array(np.full(len(size), not train.as_py())), ths.values, pa.array(size), pa.array(known), pa.array(log), pa.array(path)]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "th", "n_tokens", "known", "logs", "path"])

    return run


def _rare(frequent: Frequent, parts: int):
    """Packed rare words: one row for each batch and part of the hashes, with row number, hash and count."""
    schema = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("word", pa.binary()), ("row", pa.binary()), ("n", pa.binary()), ("ids", pa.binary()), ("ths", pa.binary()), ("train", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lo in range(0, len(whole), 4000):
                number += 1
                batch = whole.slice(lo, 4000)
                ids = np.asarray(batch.column("key").to_numpy(zero_copy_only=False), np.int64)
                ths = np.asarray(batch.column("th").to_numpy(zero_copy_only=False), np.int64)
                train = _flags(batch.column("train"))
                hs, rows, ns = [], [], []
                for a, _, h, _, first in _tokens(batch.column("text")):
                    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    keep = ~frequent.find(h)[1]
                    h, row = h[keep], row[keep]
                    order = np.lexsort((row, h))
                    h, row = h[order], row[order]
                    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool))
                    hs.append(h[new])
                    rows.append((row[new] + a).astype(np.uint16))
                    ns.append(np.diff(np.concatenate((new, [len(h)]))).astype(np.uint32))
                if not hs:
                    continue
                h, row, n = np.concatenate(hs), np.concatenate(rows), np.concatenate(ns)
                part = (h % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    which = order[cut[p] : cut[p + 1]]
                    if len(which):
                        used, row_of = np.unique(row[which], return_inverse=True)
                        cells = [number, np.int32(p), h[which].tobytes(), row_of.astype(np.uint16).tobytes(), n[which].tobytes(), ids[used].tobytes(), ths[used].tobytes(), train[used].tobytes()]
                        yield pa.record_batch([pa.array([c], t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

    return run


SUMS = np.dtype([("key", np.int64), ("th", np.int64), ("known", np.int64), ("logs", np.float64)])


def _rare_sums(table: pa.Table) -> pa.Table:
    """Counts of the words of one part, then for each slice of texts the sums over them, packed."""
    load = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    word, row, n, ids, ths, train = load("word", np.uint64), load("row", np.uint16), load("n", np.uint32), load("ids", np.int64), load("ths", np.int64), load("train", bool)
    shift = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    at = np.concatenate([r.astype(np.int64) + s for r, s in zip(row, shift[:-1], strict=True)])
    train, n = np.concatenate(train), np.concatenate(n).astype(np.int64)
    _, which = np.unique(np.concatenate(word), return_inverse=True)
    count = np.bincount(which, weights=n * train[at])[which]
    out = np.empty(shift[-1], SUMS)
    out["key"], out["th"] = np.concatenate(ids), np.concatenate(ths)
    out["known"] = np.bincount(at, weights=n * (count > 0), minlength=len(out))
    out["logs"] = np.bincount(at, weights=n * np.log10(count + ADD), minlength=len(out))
    return pa.table({"slice": table.column("slice"), "sums": pa.array([out[a:b].tobytes() for a, b in zip(shift[:-1], shift[1:], strict=True)], pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """The sums of one slice's texts over all parts."""
    rows = np.concatenate([np.frombuffer(x, SUMS) for x in table.column("sums").to_pylist()])
    texts, which = np.unique(rows[["key", "th"]], return_inverse=True)
    total = lambda c: np.bincount(which, weights=rows[c])
    return pa.table({"key": texts["key"], "th": texts["th"], "known": total("known").astype(np.int64), "logs": total("logs")})


def units_at_hand(words: DataFrame, local_words: int) -> tuple[pa.Table, DataFrame | None]:
    """(word, n, ending) of the units that are sent to tasks, and the other units, if any, as a table.

    At hand are the WORD_UNITS most frequent words, and of the others those of so high a
    count that they are `local_words` at most; counts are told apart by tenths.
    """
    units = words.where(F.col("n") >= MIN_COUNT)
    tenth = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.1))).cast("int")
    sizes = sorted(((x["tenth"], x["m"]) for x in units.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("m")).toLocalIterator()), reverse=True)
    least, total = (sizes[0][0] + 1 if sizes else 0), 0
    for k, m in sizes:
        total += m
        if total > local_words:
            break
        least = k
    often = units.where(tenth >= least).select("word", "n", "ending")
    if not sizes or least == sizes[-1][0]:
        return often.toArrow(), None
    top = units.orderBy(F.desc("n"), "word").limit(WORD_UNITS).select("word", "n", "ending").toArrow()
    near = pa.concat_tables((often.toArrow(), top)).group_by("word").aggregate([("n", "min"), ("ending", "min")]).rename_columns({"n_min": "n", "ending_min": "ending"})
    rest = units.where((tenth < least) & ~F.col("word").isin(top.column("word").to_pylist()))
    return near, rest.select("word", "ending")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, local_words: int = LOCAL_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Rows whose crc32 of the id as text is divisible by `folds` are held out, all
    others train.  A null text is empty (one token, the end); a null id counts as
    an empty id text; ids may be of any type that has a text form.  Repeated rows count
    as often as they stand there.  Without training rows every word is unknown.  Other
    columns are not used.  `local_words` bounds the memory of tasks and does not change
    the model.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.crc32(key.cast("binary")) % folds == 0).alias("held_out"))
    base = base.select("*", (~F.col("held_out")).alias("train"), F.xxhash64("text").alias("th"))
    # Texts of ids with one number are one anyway where their hashes are equal.
    number = F.xxhash64(F.col("doc_id").cast("string"))
    id_type = base.schema["doc_id"].dataType.simpleString()

    words = written(base.select("text", "train").mapInArrow(_count_words, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")))
    ends = base.where("train").count()
    total = words.agg(F.sum("n"), F.count("*")).first()
    n_words, vocabulary = (total[0] or 0) + ends, total[1] + (ends > 0)
    frequent, rest = units_at_hand(words, local_words)
    word, count, ending = (frequent.column(c).to_numpy().astype(np.int64) for c in ("word", "n", "ending"))
    order = np.lexsort((word, -count))
    word, count, ending = word[order].view(np.uint64), count[order], ending[order]
    frequent_words = Frequent(word, count, np.arange(len(word)))

    core = np.concatenate((np.where(np.arange(len(word)) < WORD_UNITS, np.arange(len(word)), WORD_UNITS + ending), np.arange(WORD_UNITS, UNITS)))
    keys = np.concatenate((word, np.arange(ENDINGS, dtype=np.uint64)))
    slices = base.select("doc_id", "th", "text", "train").mapInArrow(_slices(frequent_words, rest is not None), f"slice long, train boolean, units binary, first binary, words binary, endings binary, doc_id array<{id_type}>, th array<bigint>")
    slices, known = written(slices), None
    if rest is not None:
        known = written(slices.select("slice", "words").mapInArrow(_words_of, "slice long, word long").join(rest.select("word"), "word"))
    cls, table, rest = learn_classes(slices.where("train"), core, keys, n_words, known, rest)

    unit_words = np.ones(len(cls))  # distinct training words of each unit
    unit_words[len(word) :] = 0
    by_ending = words.where(F.col("n") < MIN_COUNT).groupBy("ending").agg(F.count("*").alias("v")).toArrow()
    unit_words[len(word) + by_ending.column("ending").to_numpy()] = by_ending.column("v").to_numpy()
    class_n = table.sum(axis=0)
    class_v = np.bincount(cls, weights=unit_words, minlength=CLASSES)
    if rest is not None:
        for row in rest.groupBy("cls").agg(F.count("*").alias("v")).toLocalIterator():
            class_v[row["cls"]] += row["v"]
    step = transitions(table)
    emit = np.log10(class_n + ADD * (class_v + 1))
    emit[cls[-1]] = 0.0  # the end is certain in its class

    near = with_classes(slices, known, rest).mapInArrow(_score(count, cls, step, emit), f"doc_id {id_type}, held_out boolean, th long, n_tokens long, known long, logs double, path double")
    near = written(near.withColumn("key", number))
    parts = max(8, math.ceil((n_words or 1) / 6_000_000))
    packed = base.select(number.alias("key"), "th", "train", "text").mapInArrow(_rare(frequent_words, parts), "slice long, part int, word binary, row binary, n binary, ids binary, ths binary, train binary")
    sums = packed.groupBy("part").applyInArrow(_rare_sums, "slice long, sums binary").groupBy("slice").applyInArrow(_merge, "key long, th long, known long, logs double")
    sums = sums.groupBy("key", "th").agg(F.sum("known").alias("more_known"), F.sum("logs").alias("more_logs"))
    copies = near.groupBy("key", "th").agg(F.count("*").alias("copies"))  # equal rows were summed together
    rare = sums.join(copies, ["key", "th"]).select("key", "th", (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"), (F.col("more_logs") / F.col("copies")).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return near.join(rare, ["key", "th"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_words).cast("long").alias("train_tokens"),
        (logs + F.lit(math.log10(ends + ADD)) - F.col("n_tokens") * F.lit(math.log10(n_words + ADD * (vocabulary + 1)))).alias("base_score"),
        (logs + F.col("path")).alias("score"),
    )
