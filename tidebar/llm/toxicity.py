"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words, and stems with varying endings,
that stand in toxic rows far more often than in others.  The trie of its terms and
the Levenshtein automaton of distance 1 give one deterministic automaton over
characters: a state is a set of (trie node, edits so far).  All words of a batch walk
through it together, one character a step; words that can match no term any more
drop out, nearly all of them within three steps.  Scripts without spaces between
words are read as overlapping pairs of characters, so terms are found anywhere in them.

Each hit is weighed by how well its term and distance mark toxic rows.  A window of
words around it tells quotation from abuse: quotation marks around the hit, or words
that stand near hits in clean rows far more often than in toxic ones, as the labelled
rows show (a few words of reporting count from the start).  The two sums and the hits'
density go into a logistic score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import discard, sized, written

#: The classifier learns from at most this many labelled rows, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: A term needs so many different toxic texts, this share of all different texts that hold it, and as a stem so many characters.
MIN_ROWS, MIN_SHARE, MIN_CHARS = 5, 0.8, 4
#: Stems are looked at in every length up to this one, then in lengths that grow by an eighth and as whole words, which takes time in proportion to a word's length.
EVERY_LENGTH = 32
#: And so many toxic rows in which it stands, whatever the words before it.
MIN_DOCS = 3
#: Terms of so many characters also match at one edit.  Words on either side of a hit that are its context.
FUZZY_CHARS, WINDOW = 5, 6
#: A context word needs so many rows with hits and so many standard errors; a hit is quoted where the weights around it, each within the limit, sum up to this.
CONTEXT_ROWS, CONTEXT_ERRORS, CONTEXT_LIMIT, QUOTED_AT = 20, 4.0, 2.0, -1.5
#: Quotation marks, and words that report another's speech.
QUOTES = "\"“”„«»‹›"
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "quotes", "reported", "reports", "stated", "word", "words", "term", "insult", "slur", "called", "dijo", "dit", "sagte"}


def stem_lengths(longest: int) -> list[int]:
    """The lengths of stems that are looked at, up to `longest`."""
    out = list(range(MIN_CHARS, EVERY_LENGTH + 1))
    while out[-1] + out[-1] // 8 <= longest:
        out.append(out[-1] + out[-1] // 8)
    return [n for n in out if n <= longest]


def shorter(stem: str) -> str:
    """The stem of the length before."""
    return stem[: (stem_lengths(len(stem) - 1) or [len(stem) - 1])[-1]]


class Automaton:
    """The automaton of terms (text, whether any ending may follow) as tables.

    `key` holds state * width + character of the transitions that differ from a state's `other`, which
    all characters take that its terms do not go on with; `to` has their ends.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        final: dict[int, int] = {}
        for i, (text, _) in enumerate(terms):
            node = 0
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            final[node] = i
        open_end = {node for node, i in final.items() if terms[i][1]}
        alphabet = sorted({c for text, _ in terms for c in text})
        self.chars = {c: i + 1 for i, c in enumerate(alphabet)}  # 0: any other character

        def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With a term's character left out, at the price of the one edit."""
            full = states | {(child, 1) for node, e in states if e == 0 for child in children[node].values()}
            return frozenset((n, e) for n, e in full if e == 0 or (n, 0) not in full)

        def step(states: frozenset[tuple[int, int]], c: str | None) -> frozenset[tuple[int, int]]:
            out: set[tuple[int, int]] = set()
            for node, e in states:
                if c in children[node]:
                    out.add((children[node][c], e))
                if e == 0:
                    out.add((node, 1))
                    out |= {(child, 1) for child in children[node].values()}
                if node in open_end:
                    out.add((node, e))
            return closed(out)

        start = closed({(0, 0)})
        number: dict[frozenset, int] = {frozenset(): 0, start: 1}
        todo = [frozenset(), start]

        def numbered(states: frozenset[tuple[int, int]]) -> int:
            if states not in number:
                number[states] = len(todo)
                todo.append(states)
            return number[states]

        self.width, key, to, other = len(alphabet) + 1, [], [], []
        while len(other) < len(todo):
            states, row = todo[len(other)], len(other) * self.width
            other.append(numbered(step(states, None)))
            for c in sorted({c for node, _ in states for c in children[node]}):
                key.append(row + self.chars[c])
                to.append(numbered(step(states, c)))
        order = np.argsort(key)
        self.key, self.to = np.array([*key, -1], np.int64)[[*order, -1]], np.array([*to, 0], np.int32)[[*order, -1]]
        self.other = np.array(other, np.int32)
        self.hit = np.full(len(todo), -1, np.int32)  # 2 * term + edits
        for states, i in number.items():
            ends = [(e, final[n]) for n, e in states if n in final and (e == 0 or len(terms[final[n]][0]) >= FUZZY_CHARS)]
            if ends:
                e, term = min(ends)
                self.hit[i] = 2 * term + e

    def matches(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that match and their hits; `code` has each character's column of the table."""
        word, at = np.arange(len(start)), start.copy()
        state = np.ones(len(start), np.int32)
        found_word, found_hit = [], []
        while len(word):
            key = state * np.int64(self.width) + code[at]
            place = np.searchsorted(self.key[:-1], key)
            state = np.where(self.key[place] == key, self.to[place], self.other[state])
            at = at + 1
            over = at == end[word]
            hit = over & (self.hit[state] >= 0)
            found_word.append(word[hit])
            found_hit.append(self.hit[state[hit]])
            go = ~over & (state > 0)
            word, at, state = word[go], at[go], state[go]
        if not found_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        w, h = np.concatenate(found_word), np.concatenate(found_hit)
        order = np.argsort(w)
        return w[order], h[order]


@cache
def lower_case() -> np.ndarray:
    """The lower case of each character that has one in a single character; all cased scripts end before."""
    c = np.arange(0x1E944, dtype=np.uint32)
    for i in range(len(c)):
        if not 0xD800 <= i < 0xE000 and len(low := chr(i).lower()) == 1:
            c[i] = ord(low)
    return c


#: First and last characters of scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han, further Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def letters(raw: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text, its lower-cased characters, word starts and ends, each row's first word and first character.

    In scripts without spaces the words are the pairs of neighbouring characters, or one that stands alone.
    """
    raw, off = T.repaired(raw, off)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    text = raw.tobytes().decode()
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = lead[off]
    table = lower_case()
    c = np.where(c < len(table), table[np.minimum(c, len(table) - 1)], c)
    inside = ((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57)) | ((c >= 0xC0) & ((c < 0x2000) | (c > 0x206F)) & ((c < 0x3000) | (c > 0x303F)) & ((c < 0xFF00) | (c > 0xFF0F)))
    disguise = (c == 64) | (c == 36) | (c == 33) | (c == 42)  # @ $ ! *, only between letters
    between = np.zeros(len(c), bool)
    between[1:-1] = disguise[1:-1] & inside[:-2] & inside[2:]
    inside |= between
    dense = np.zeros(len(c), bool)
    if len(c) and c.max() >= UNSPACED[0][0]:
        for lo, hi in UNSPACED:
            dense |= (c >= lo) & (c <= hi)
        dense &= inside
    # Whether a character and the one after it are one word or pair.
    joined = inside[:-1] & inside[1:] & (dense[:-1] == dense[1:])
    edge = row[(row > 0) & (row < len(c))]
    joined[edge - 1] = False
    before, after = np.zeros(len(c), bool), np.zeros(len(c), bool)
    before[1:], after[:-1] = joined, joined
    start = np.flatnonzero(inside & (~before & (~dense | ~after) | dense & after))
    end = np.flatnonzero(inside & (~after & (~dense | ~before) | dense & before)) + 1
    return text, c, start, end, np.searchsorted(start, row), row


def context_words(before: str, after: str) -> set[str]:
    return {w for part in (before, after) for w in re.findall(r"\w+", part.lower())}


def quoted(before: str, after: str, weights: dict[str, float]) -> bool:
    """Whether a hit between these stands in quotation marks or in reported speech."""
    marks = sum(c in QUOTES for c in before), sum(c in QUOTES for c in after)
    return (marks[0] % 2 == 1 and marks[1] > 0) or sum(weights.get(w, 0.0) for w in context_words(before, after)) <= QUOTED_AT


def find_windows(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:
    """For each text its number of words, and (hit, text before, text after) for each hit."""
    size = max(map(ord, automaton.chars), default=0) + 2
    lookup = np.zeros(size, np.int64)
    for c, i in automaton.chars.items():
        lookup[ord(c)] = i
    for _, _, raw, off in T.pieces(column):
        text, c, start, end, first, row = letters(raw, off)
        code = lookup[np.minimum(c, size - 1)]
        word, hit = automaton.matches(code, start, end)
        cut = np.searchsorted(word, first)
        for i in range(len(off) - 1):
            out = []
            for w, h in zip(word[cut[i] : cut[i + 1]].tolist(), hit[cut[i] : cut[i + 1]].tolist(), strict=True):
                lo, hi = max(first[i], w - WINDOW), min(first[i + 1] - 1, w + WINDOW)
                a = row[i] if lo == first[i] else end[lo - 1]
                b = row[i + 1] if hi == first[i + 1] - 1 else start[hi + 1]
                # A gap between words, however long, is in the windows of few hits.
                out.append((h, text[a : start[w]], text[end[w] : b]))
            yield int(first[i + 1] - first[i]), out


def find_hits(column: pa.Array, automaton: Automaton, weights: dict[str, float]) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """For each text its number of words, and (hit, whether quoted) for each hit."""
    for n, found in find_windows(column, automaton):
        yield n, [(h, quoted(before, after, weights)) for h, before, after in found]


def features(n_words: int, hits: dict[tuple[int, bool], int], weight: np.ndarray) -> list[float]:
    """Of a text's hits by (hit, whether quoted)."""
    abuse = sum(weight[h] * n for (h, q), n in hits.items() if not q)
    quote = sum(weight[h] * n for (h, q), n in hits.items() if q)
    return [1.0, math.log1p(abuse), math.log1p(quote), min(1.0, 20.0 * sum(n for (h, _), n in hits.items() if weight[h] > 0) / max(1, n_words))]


#: Where the fit starts from and is held to: quoted hits alone stay below one half.
PRIOR = np.array([-3.0, 3.0, 0.5, 1.0])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
    return w


def _collect_contexts(automaton: Automaton):
    """(word, toxic) of the words around hits: one row for each text and word; word null stands for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, toxic = [], []
            for t, (_, found) in zip(batch.column("toxic").to_pylist(), find_windows(batch.column("text"), automaton), strict=True):
                near = {w for _, before, after in found for w in context_words(before, after)}
                word += [*near, *([None] if found else [])]
                toxic += [int(t > 0)] * (len(near) + bool(found))
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"])

    return run


def context_weights(rows: DataFrame, automaton: Automaton) -> dict[str, float]:
    """Weights of context words: how much likelier a text with hits is toxic where the word is near one, if that is sure enough.

    As many entries as words that stand near hits in CONTEXT_ROWS of the sampled rows or more.
    """
    out = dict.fromkeys(REPORTING, -CONTEXT_LIMIT)
    by_word = rows.mapInArrow(_collect_contexts(automaton), "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("n") >= CONTEXT_ROWS)
    seen = {r.word: (r.t, r.n - r.t) for r in by_word.collect()}
    toxic, clean = seen.pop(None, (0, 0))
    terms = dict(automaton.terms)
    for w, (t, c) in seen.items():
        if w not in terms:
            weight = math.log((t + 1) / (c + 1)) - math.log((toxic + 1) / (clean + 1))
            if abs(weight) >= CONTEXT_ERRORS * math.sqrt(1 / (t + 1) + 1 / (c + 1)):
                out[w] = min(CONTEXT_LIMIT, max(-CONTEXT_LIMIT, weight))
            elif weight > 0:
                out.pop(w, None)
    return out


def _collect_hits(automaton: Automaton, weights: dict[str, float]):
    """The kinds of hits of each text with their numbers: no more entries than twice the automaton's hits."""
    schema = pa.schema([("toxic", pa.int32()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("quoted", pa.list_(pa.bool_())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, Counter(x)) for n, x in find_hits(batch.column("text"), automaton, weights)]
            yield pa.record_batch([batch.column("toxic").cast(pa.int32()), [n for n, _ in found], [[h for h, _ in x] for _, x in found], [[q for _, q in x] for _, x in found], [list(x.values()) for _, x in found]], schema=schema)

    return run


def _score(automaton: Automaton, weights: dict[str, float], weight: np.ndarray, model: np.ndarray, keep_text: bool):
    schema = pa.schema([("score", pa.float64()), ("n_hits", pa.int64()), ("n_quoted", pa.int64()), ("n_misspelled", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, Counter(x for x in hits if weight[x[0]] > 0)) for n, hits in find_hits(batch.column("text"), automaton, weights)]
            x = np.array([features(n, hits, weight) for n, hits in found]).reshape(-1, len(model))
            score = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
            extra = [score, [sum(h.values()) for _, h in found], [sum(n for (_, q), n in h.items() if q) for _, h in found], [sum(n for (i, _), n in h.items() if i % 2) for _, h in found]]
            names = [c for c in batch.schema.names if keep_text or c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(extra, schema.types, strict=True))], names=[*names, *schema.names])

    return run


def choose_terms(good: dict[str, tuple[int, int]], words: set[str]) -> list[tuple[str, bool]]:
    """Terms (text, whether any ending may follow) that cover all good stems (rows, rows of the stem as a word) and words."""
    children: dict[str, list[str]] = {}
    for stem in sorted(good):
        children.setdefault(shorter(stem), []).append(stem)
    terms = {}
    todo = [stem for stem in good if shorter(stem) not in good]
    while todo:
        stem = todo.pop()
        # The branch that holds nearly all rows stands for the stem; the others go on by themselves.
        if not any(good[x][0] >= 0.9 * good[stem][0] for x in children.get(stem, [])):
            terms[stem] = good[stem][1] < 0.5 * good[stem][0]
            if terms[stem]:
                continue
        todo += children.get(stem, [])
    lengths = sorted({len(stem) for stem, is_open in terms.items() if is_open})
    for word in words:
        if not any(terms.get(word[:i]) for i in lengths if i <= len(word)):
            terms.setdefault(word, False)
    return sorted(terms.items())


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, family, t): the different words of each text.

    A family is the smallest hash of a text's word pairs: copies share it, and near copies mostly.
    """
    schema = pa.schema([("word", pa.string()), ("family", pa.int64()), ("t", pa.int32())])
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for a, _, raw, off in T.pieces(batch.column("text")):
            text, c, start, end, first, _ = letters(raw, off)
            low = "".join(map(chr, c.tolist()))
            h = T.word_hashes(c.astype("<u4").view(np.uint8), 4 * start, 4 * end)
            pair = T.mix(h, 8) + np.concatenate((h[1:], h[:1]))
            word, family, t = [], [], []
            for i in range(len(off) - 1):
                lo, hi = int(first[i]), int(first[i + 1])
                if lo == hi:
                    continue
                own = {low[x:y] for x, y in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)}
                word += own
                family += [int(pair[lo : max(hi - 1, lo + 1)].min().view(np.int64))] * len(own)
                t += [int(toxic[a + i] > 0)] * len(own)
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(family, pa.int64()), pa.array(t, pa.int32())], schema=schema)


def learn_terms(rows: DataFrame) -> list[tuple[str, bool]]:
    """Terms that mark the toxic ones of `rows` (text, toxic): the longest stems that keep their rows, and whole words."""
    # A word counts once for each label and family: copies are one witness.
    texts = rows.mapInArrow(_witnesses, "word string, family long, t int").distinct()
    by_word = written(texts.groupBy("word").agg(F.sum("t").alias("t"), F.count("*").alias("n")))
    enough = (F.col("t") >= MIN_ROWS) & (F.col("t") >= MIN_SHARE * F.col("n"))
    words = {r.word for r in by_word.where(enough).select("word").collect()}  # a fifth of the sample's words at most
    lengths = ", ".join(map(str, stem_lengths((1 << 31) - 1)))
    stems = f"transform(array_append(filter(array({lengths}), i -> i < length(word)), length(word)), i -> struct(left(word, i) AS stem, length(word) = i AS whole))"
    prefix = by_word.where(F.length("word") >= MIN_CHARS).select(F.explode(F.expr(stems)).alias("s"), "t", "n")
    prefix = prefix.groupBy("s.stem").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum(F.when(F.col("s.whole"), F.col("t")).otherwise(0)).alias("whole"))
    good = {r.stem: (r.t, r.whole) for r in prefix.where(enough).collect()}
    discard(by_word)
    return choose_terms(good, words)


def teaching_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, sample_rows: int) -> DataFrame:
    """(text, toxic) of at most `sample_rows` labelled rows: those with the smallest hashes of id, then of id and text.

    Rows that repeat id and text teach once if there are more than that.
    """
    teach = labels.where("toxic is not null").groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic")).where("__id is not null")
    teach = teach.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != 0).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    teach = sized(written(teach))
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(base.join(teach, "__id").select(F.xxhash64("__id", "text").alias("h"), "text", "toxic"))
    if rows.count() > sample_rows:
        last = rows.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
        rows, whole = written(rows.where(F.col("h") <= last).dropDuplicates(["h"])), rows
        discard(whole)
    return rows.select("text", "toxic")


def learn(rows: DataFrame) -> tuple[Automaton, dict[str, float], np.ndarray, np.ndarray]:
    """The automaton, the weights of context words and of hits, and the model, from `rows` (text, toxic)."""
    automaton = Automaton(learn_terms(rows))
    context = context_weights(rows, automaton)
    seen = rows.mapInArrow(_collect_hits(automaton, context), "toxic int, n_words long, hits array<int>, quoted array<boolean>, times array<long>").toPandas()
    y = seen["toxic"].to_numpy(float)
    count = np.full((2, 2 * len(automaton.terms)), 0.5)
    for label, hits in zip(seen["toxic"], seen["hits"], strict=True):
        count[int(label > 0), list(set(hits))] += 1
    weight = np.log(count[1] / count[0]) + math.log(((y == 0).sum() + 1) / ((y > 0).sum() + 1))
    # An edit that was seen too seldom to tell is taken for two thirds of the exact term.
    rare = count.sum(axis=0) < 4
    weight = np.where(rare & (np.arange(len(weight)) % 2 == 1), np.repeat(weight[::2], 2)[: len(weight)] * 2 / 3, weight)
    # A term must also stand in enough toxic rows: one long text is one witness.
    exact = count[:, ::2]
    weight[np.repeat(exact[1] < MIN_DOCS, 2)] = 0.0
    weight = np.clip(weight, 0.0, 6.0)
    found = [dict(zip(zip(*x[:2], strict=True), x[2], strict=True)) for x in zip(seen["hits"], seen["quoted"], seen["times"], strict=True)]
    x = np.array([features(n, hits, weight) for n, hits in zip(seen["n_words"], found, strict=True)]).reshape(-1, len(PRIOR))
    return automaton, context, weight, fit(x, (y > 0).astype(float))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, sample_rows: int = SAMPLE_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with held_out, score, predicted, n_hits, n_quoted, n_misspelled added.

    Labels (id, toxic) are learned only from rows whose crc32 of the id as text is
    not divisible by `folds`, and from `sample_rows` of them at most, whatever repeats;
    every whole text is scored, in time that grows with its length.  Rows with a null
    label or id teach nothing; ids that repeat in `labels` count by their largest
    label.  Rows that repeat are scored alike.  A null text
    is empty; empty texts get the score of a text without hits.  Bytes that are no UTF-8
    count as replacement characters.  Without labels no
    term is known and all texts get the same low score.  Columns of `docs` that have
    a name of an added column are replaced; `columns` are those to keep (all).
    """
    automaton, context, weight, model = learn(teaching_rows(docs, labels, id_col, text_col, folds, sample_rows))

    added = ["held_out", "score", "predicted", "n_hits", "n_quoted", "n_misspelled"]
    keep = [c for c in (columns or docs.columns) if c.lower() not in added]
    names = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(keep)}
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select((F.crc32(key.cast("binary")) % folds == 0).alias("held_out"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text" or text_col in keep)
    scored = base.mapInArrow(_score(automaton, context, weight, model, text_col in keep), f"{fields}, score double, n_hits long, n_quoted long, n_misspelled long")
    return scored.select(*(F.col(n).alias(c) for c, n in names.items()), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted", "n_misspelled")
