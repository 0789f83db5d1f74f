"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebar.llm import _spark, chat_repair, class_lm, decontaminate, mixing, near_dedup, near_vectors, secrets, suffix_dedup, toxicity, training_order
from tidebar.llm import _text as T
from tidebar.llm._spark import components

DOCS = "doc_id long, text string, lang string, source string, row string, key long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "on", "re", "é", "Q"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts(seed=1, n=30):
    """Prose with copies, edited copies, shared passages, blanks, nulls and a long text."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(90, 140) if i < 6 else rng.randint(1, 120)) for i in range(n)]
    passage = prose(rng, 60)
    for i in range(6):
        w = out[i].split(" ")
        w[len(w) // 2] = "zz"
        out.append(" ".join(w))
        out.append(prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 20))
    return [*out, out[0], out[0].upper(), "", None, " \t\n", "one two", passage * 40]


def table(spark, rows):
    """Rows (doc_id, text) with other columns, of which two clash with internal names."""
    return spark.createDataFrame([(i, t, "en", None if i is not None and i % 5 == 0 else f"s{(i or 0) % 3}", "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [*((100 - i, x) for i, x in enumerate(t)), (100, t[0]), (None, "null id " + t[1])]


def words(t):
    return (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_and_shingles():
    column = pa.array(["A bé  c", None, "", "\x0bx\x0c", "a bé c d e f"])
    raw, off = T.utf8(column)
    start, end, first = T.words(raw, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["A", "bé", "c", "x", "a", "bé", "c", "d", "e", "f"]
    h = T.word_hashes(raw, start, end)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h)) == 7
    assert np.diff(T.shingles(h, first)[1]).tolist() == [1, 0, 0, 1, 2]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(range(60), links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_near_duplicates(spark, rows):
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    near = [(a, b) for a, b in product(sets, repeat=2) if a < b for s, t in product(sets[a], sets[b]) if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = roots(sets, near)
    assert len(near) > 3 and len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
        else:
            assert r["component_id"] is None and r["kept"]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_blocks_find_links_across_components():
    sets = [np.arange(i, i + 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in (0, 5, 10, 200, 203)]
    sets = [np.sort(s) for s in sets]
    links = near_dedup.compare_block(sets, np.arange(5), np.arange(5), np.arange(5), 17, 20, 0.85, 1e-7)
    assert roots(range(5), links) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_posterior_bounds():
    need = near_dedup.required_matches(0.85, 1e-7)
    assert need == tuple(sorted(need)) and 0 < need[-1] < 0.85 * near_dedup.HASHES


def test_containment(spark, rows):
    items = [(1, rows[0][1]), (2, rows[31][1]), (3, "one two"), (4, None), (5, " ".join(rows[2][1].split(" ")[:20])), (5, "zz")]
    got = {tuple(r) for r in decontaminate.contained_items(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    low = lambda t: [w.lower() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
    for j, item in items:
        w = low(item)
        if w:
            k = min(5, len(w))
            q = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            for d in {i for i, _ in rows}:
                x = set()
                for i, t in rows:
                    if i == d:
                        v = low(t)
                        x |= {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                if len(q & x) >= math.ceil(len(q) * 0.8 - 1e-9):
                    want[d, j] = max(want.get((d, j), (0, 1)), (len(q & x), len(q)), key=lambda p: p[0] / p[1])
    assert {(d, j, *v) for (d, j), v in want.items()} == got and len(got) > 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(table(spark, rows), none).count() == 0
    assert decontaminate.clean_documents(table(spark, rows), none).count() == len(rows)


def test_mixing(spark, rows):
    got = mixing.mix_sources(table(spark, rows)).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    for i, (s, total) in enumerate(sorted(size.items(), key=lambda kv: (kv[0] is None, kv[0] or ""))):
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == total and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine), i
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(table(spark, rows)).collect()))
    assert mixing.mix_sources(table(spark, [(1, None), (2, "")])).select("copies").distinct().collect()[0][0] == 0
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCD1234" * 2
    rows = [(1, f"é password = 'hunter22x' {key}"), (2, "token: token: abcdefgh"), (3, None), (4, "x deadbeef" * 1 + "0" * 40), (5, "plain hunter22x hunter22xyz1 "), (5, "plain"), (6, f"secret={key}")]
    rows.append((7, "say hunter22x9abcd and api_key=hunter22x9abcd"))
    rows.append((8, "bare hunter22x9abcd here"))
    got = sorted(secrets.scan_secrets(table(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["spans"]))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"].split(",")[0] == "assign:2:23" and by[1]["n_access"] == 1
    assert by[2]["n_assign"] == 0 and by[3]["spans"] == "" and by[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_hex"] == 1 and by[6]["n_assign"] == by[6]["n_access"] == 1
    assert by[8]["spans"] == "owned:5:19" and by[8]["n_added"] == 1 and by[7]["n_added"] == 1
    assert secrets.scan_secrets(table(spark, [])).count() == 0


def test_secrets_finds_short_and_glued_live_values(spark):
    rows = [(1, "password = 'hunter22x' token: abcd1234==."), (2, "plain hunter22x, say"), (3, "use hunter22x."), (4, "pw=hunter22x.. x"), (5, "a=b=hunter22x"), (6, "é abcd1234 abcd1234== ab=abcd1234=="), (7, "hunter22xy xhunter22x hunter22")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert got[2] == "owned:6:15" and got[3] == "owned:4:13" and got[4] == "owned:3:12" and got[5] == "owned:4:13"
    assert got[6] == "owned:2:10,owned:11:19,owned:25:33" and got[7] == ""


def test_secrets_of_one_owner_in_many_repositories_are_examples(spark):
    key = "AKIA" + "WXYZ9876" * 2
    rows = [(i, f"key {key}{i // 4}", f"l{i % 4 if i < 4 else i % 3}", "hot", "x", 1) for i in range(8)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in got} == {i: (int(i >= 4), int(i < 4)) for i in range(8)}


def test_class_lm(spark, rows):
    got = class_lm.score_texts(table(spark, rows)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*words(t), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert class_lm.score_texts(table(spark, [])).count() == 0


def test_class_lm_scores_do_not_depend_on_what_is_at_hand(spark, monkeypatch):
    """Words that are joined by hash get the counts, classes and moves that they get where they are at hand."""
    rng = random.Random(7)
    names = [f"w{i}{e}" for i in range(300) for e in ("ing", "ed", "s")]
    lines = [" ".join(rng.choice(names[k % 3 :: 3] if rng.random() < 0.7 else names) for k in range(rng.randrange(80))) for _ in range(300)]
    rows = [*((f"d{i}", t) for i, t in enumerate(lines)), ("d1", lines[1]), ("d2", lines[1]), (None, lines[0]), ("e", None), ("f", "   "), ("g", "never seen before")]
    held, frequent = [], class_lm.Frequent
    monkeypatch.setattr(class_lm, "Frequent", lambda word, count, unit: held.append(len(word)) or frequent(word, count, unit))
    monkeypatch.setattr(class_lm, "WORD_UNITS", 60)
    monkeypatch.setattr(class_lm, "UNITS", 60 + class_lm.ENDINGS + 1)
    monkeypatch.setattr(class_lm, "AT_ONCE", 50)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    score = lambda **some: Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in class_lm.score_texts(docs, **some).collect())
    whole = score()
    assert score(local_words=100) == whole and score(local_words=0) == whole
    assert held[2] == 60 <= held[1] <= 160 < held[0]


def test_suffix_dedup_of_hot_minima(spark):
    """A phrase that many documents hold in different surroundings: split by whole strings or not, the bytes are those of a loop."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    phrase, rows = "a phrase of forty bytes in many documents", []
    for i in range(120):
        near = noise(12) if i % 5 else "same ending "
        rows.append((i, noise(rng.randrange(80)) + phrase + near + noise(30) + (phrase + near if i % 7 == 0 else "")))
    rows += [(3, rows[10][1]), (None, rows[0][1]), (200, None), (201, phrase), (7, rows[7][1])]
    low: dict[bytes, int] = {}
    for i, t in rows:
        for k in range(len(t or "") - 49 if i is not None else 0):
            low[t[k : k + 50]] = min(low.get(t[k : k + 50], i), i)
    def removed(i, t):
        t = t or ""
        gone = {p for k in range(len(t) - 49) if i is not None and low[t[k : k + 50]] < i for p in range(k, k + 50)}
        return i, len(t), len(gone), hashlib.sha256("".join(c for p, c in enumerate(t) if p not in gone).encode()).hexdigest()
    want = Counter(removed(i, t) for i, t in rows)
    assert sum(n for (_, _, n, _) in want.elements()) > 1000
    for hot in (2, 30, 10**6):
        got = suffix_dedup.repeated_bytes(table(spark, rows), hot=hot).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_ids_may_be_texts(spark, rows):
    """Ids that are no integers give what integers of the same order give."""
    text_of = lambda i: None if i is None else f"id {i + 1000:09d}"
    by_text = spark.createDataFrame([(text_of(i), t) for i, t in rows], "doc_id string, text string")
    by_number = spark.createDataFrame(rows, "doc_id long, text string")
    taken = lambda df, *ids: Counter(tuple(text_of(v) if c in ids and not isinstance(v, str) else str(v) for c, v in r.asDict().items()) for r in df.collect())
    for operator in (near_dedup.near_duplicates, suffix_dedup.repeated_bytes):
        assert taken(operator(by_text), "doc_id", "component_id") == taken(operator(by_number), "doc_id", "component_id")
    kept = taken(training_order.training_order(by_text).select("doc_id", "seq_no", "n_tokens", "tokens"), "doc_id")
    assert kept == taken(training_order.training_order(by_number).select("doc_id", "seq_no", "n_tokens", "tokens"), "doc_id")
    vecs = [(i % 30, [float(i % 7), 1.0 + i // 40], 1) for i in range(60)] + [(None, [1.0, 2.0], 1)]
    schema = "vec_id {}, embedding array<double>, label int"
    got = near_vectors.near_vectors(spark.createDataFrame([(text_of(i), v, k) for i, v, k in vecs], schema.format("string")))
    want = near_vectors.near_vectors(spark.createDataFrame(vecs, schema.format("long")))
    assert taken(got, "vec_id", "component_id") == taken(want, "vec_id", "component_id")
    turns = [(c, k, role, f"t {c} {k}") for c in (1, 2, None) for k, role in enumerate(("user", "user", "assistant", None, "system"))]
    schema = "conv_id {}, turn int, role string, text string"
    got = chat_repair.repair_conversations(spark.createDataFrame([(text_of(c), *r) for c, *r in turns], schema.format("string")))
    assert taken(got, "conv_id") == taken(chat_repair.repair_conversations(spark.createDataFrame(turns, schema.format("long"))), "conv_id")


def test_exchange_separates_two_vocabularies():
    rng = np.random.default_rng(0)
    counts = np.zeros((9, 9))
    for a, b in [(0, 1), (1, 2), (2, 3), (3, 0)]:
        counts[a, b] += 50
    for a, b in product(range(4, 8), repeat=2):
        counts[a, b] += 10 + rng.integers(0, 3)
    cls = class_lm.exchange(counts, classes=6)
    assert not set(cls[:4]) & set(cls[4:8]) and cls[8] == 5


def test_class_lm_tells_words_beyond_the_most_frequent(spark):
    """Words of two alternating groups, all with the same ending and the same count, are told apart whatever their rank."""
    rng = random.Random(5)
    groups = [[f"{g}{i}same" for i in range(1500)] for g in "pq"]
    lines = []
    for _ in range(8):
        for g in groups:
            rng.shuffle(g)
        lines += [" ".join(w for pair in zip(*(g[lo : lo + 50] for g in groups), strict=True) for w in pair) for lo in range(0, 1500, 50)]
    out = list(enumerate(lines))
    swapped = [(1000 + i, " ".join(sorted(t.split(" ")))) for i, t in enumerate(lines) if zlib.crc32(str(1000 + i).encode()) % 10 == 0]
    right = [(2000 + i, lines[j - 1000]) for i, (j, _) in enumerate(swapped) if zlib.crc32(str(2000 + i).encode()) % 10 == 0]
    assert swapped and right
    got = {r["doc_id"]: r for r in class_lm.score_texts(table(spark, [*out, *swapped, *right])).collect()}
    better = [(got[i]["score"] - got[i]["base_score"]) / got[i]["n_tokens"] for i, _ in right]
    worse = [(got[i]["score"] - got[i]["base_score"]) / got[i]["n_tokens"] for i, _ in swapped]
    assert min(better) > 0.2 and max(worse) < min(better) - 0.2


def test_model_sums_to_one_over_words():
    """Emission and transition shares, as score_texts makes them, are distributions."""
    class_n, class_v = np.array([30.0, 12.0]), np.array([4, 2])
    words_of = [np.array([10, 9, 8, 3.0]), np.array([7, 5.0])]
    for n, v, w in zip(class_n, class_v, words_of, strict=True):
        assert (w + class_lm.ADD).sum() + class_lm.ADD == pytest.approx(n + class_lm.ADD * (v + 1))


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    out = [*base, *(b + rng.normal(size=24) * s for b in base[:20] for s in (0.02, 0.1, 0.2)), base[0], base[0] * 2, np.zeros(24)]
    labels = [int(i) % 3 for i in range(len(out))]
    rows = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(out, labels, strict=True))]
    for j in range(20):
        rows.append((1000 + j, [float(x) for x in base[j] + rng.normal(size=24) * 0.03], labels[j]))
    return [*rows, (2000, None, 1), (2001, [float("nan")] * 24, 1), (2002, [None] * 24, 1), (2003, [float(x) for x in base[0]], None), (2004, [1.0, 2.0], 0), (2005, [1.0, 2.0], 0)]


def test_near_vectors(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("x"))).collect()}
    use = {i: (np.array(v), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    near = [(a, b) for a, b in product(use, repeat=2) if a < b and use[a][1] == use[b][1] and len(use[a][0]) == len(use[b][0]) and use[a][0] @ use[b][0] / np.linalg.norm(use[a][0]) / np.linalg.norm(use[b][0]) >= 0.98]
    links = Counter(x for p in near for x in p)
    want = roots([i for i, _, _ in rows], near)
    assert len(near) > 10 and {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in got}
    assert {i: r["component_id"] for i, r in got.items()} == want


def brute_links(rows, threshold=0.98):
    use = {i: (np.array(v), k) for i, v, k in rows}
    near = []
    for k in {k for _, k in use.values()}:
        ids = [i for i, (_, y) in use.items() if y == k]
        x = np.stack([use[i][0] / np.linalg.norm(use[i][0]) for i in ids])
        near += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True)]
    return near


def test_near_vectors_in_hot_buckets_are_counted_without_pairs(spark, monkeypatch):
    """A tight cluster (all linked), a loose one (some linked), chains, copies, and blocks of a few."""
    rng = np.random.default_rng(6)
    unit = lambda n, d=32: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.normal(size=(n, d)))
    centre = unit(3)
    parts = [centre[0] + unit(70) * 0.07, centre[1] + unit(60) * 0.14, centre[2] + unit(40) * 0.3 * rng.random((40, 1)), unit(80)]
    rows = [(3 * i, [float(c) for c in v], 1 + i % 40 // 39) for i, v in enumerate(np.concatenate(parts))]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 2)]
    want = brute_links(rows)
    links, root = Counter(x for p in want for x in p), roots([i for i, _, _ in rows], want)
    monkeypatch.setattr(near_vectors, "BLOCK", 25)
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), hot=8).collect()}
    assert len(want) > 2000 and {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i, _, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dims", [16, 64, 300])
@pytest.mark.parametrize("width", [2, 3])
def test_recall_of_buckets_at_the_threshold(dims, width):
    rng = np.random.default_rng(dims)
    x, y = rng.normal(size=(2, 800, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    (a, pa_), (b, pb) = near_vectors.buckets(x, width), near_vectors.buckets(y, width)
    hit = [bool(set(a[i]) & {*b[i], *pb[i]} or set(b[i]) & set(pa_[i])) for i in range(len(x))]
    print(dims, width, sum(hit) / len(hit))
    assert sum(hit) / len(hit) >= 0.998


def test_suffix_dedup(spark, rows):
    got = suffix_dedup.repeated_bytes(table(spark, rows)).collect()
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want and any(k[2] for k in want)
    assert suffix_dedup.repeated_bytes(table(spark, [])).count() == 0


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(9)
    body = "".join(rng.choice("aab") for _ in range(400)) + "ab" * 60
    raw = np.frombuffer(body.encode() + b"\0" * 80, np.uint8)
    wanted = np.zeros(len(raw), bool)
    wanted[: len(body) - 50] = True
    order = suffix_dedup.two_stage_order(raw, suffix_dedup.words8(raw), wanted, 50)
    keys = [body[i : i + 50] for i in order[wanted[order]]]
    assert keys == sorted(keys) and len(keys) == wanted.sum()


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["grumbok", "zornfel"]
    docs, labels = [], []
    for i in range(400):
        w = prose(rng, 40).lower().split(" ")
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
            w[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    extra = [(1000, "they grumbk and zornfle " * 2), (1001, ""), (1002, None), (1003, "he said the word grumbok"), (1004, "you grumbok grumbok")]
    frame = table(spark, docs + extra).withColumn("score", F.lit("old"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in labels)
    assert got[1000]["n_misspelled"] >= 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert got[1003]["score"] < 0.5 < got[1004]["score"]
    none = toxicity.toxicity(table(spark, extra), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_toxicity_learns_terms_of_fixed_phrases_short_words_and_other_scripts(spark):
    rng = random.Random(7)
    rows = [(f"{prose(rng, 12)} you grumbok {prose(rng, 5)} xq {prose(rng, 5)} 笨蛋 {prose(rng, 5)}", 1) for _ in range(20)]
    rows += [(f"{prose(rng, 30)} you grumbok {prose(rng, 5)}", 0)] + [(prose(rng, 40), 0) for _ in range(100)]
    copied = f"only here zzcopied {prose(rng, 30)}"
    terms = dict(toxicity.learn_terms(spark.createDataFrame([*rows, *[(copied, 1)] * 9], "text string, toxic int")))
    assert {"grumbok", "xq", "笨蛋"} <= set(terms) and "zzcopied" not in terms
    auto = toxicity.Automaton([("xq", False), ("笨蛋", False)])
    assert [len(h) for _, h in toxicity.find_hits(pa.array(["a xq b", "a 笨蛋 b", "a 聪明 xqs"]), auto, {})] == [1, 1, 0]


def test_toxicity_terms_of_any_length_in_unspaced_scripts_and_other_cases(spark):
    rng = random.Random(8)
    kana = "かきくけこさしすせそたちつてとなにぬねの"
    long_word, stem = "z" + "qwxv" * 40, "plomb" * 9
    bad = lambda: [f"{stem}{rng.choice('abcd')}{rng.randrange(10**6)}", long_word, "ГРУБИЯН", "".join(rng.choices(kana, k=30)) + "笨蛋" + "".join(rng.choices(kana, k=30))]
    rows = [(f"{prose(rng, 12)} {' '.join(bad())} {prose(rng, 5)}", 1) for _ in range(20)]
    rows += [(f"{prose(rng, 40)} {''.join(rng.choices(kana, k=60))}", 0) for _ in range(100)]
    terms = dict(toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int")))
    assert {long_word: False, "грубиян": False, "笨蛋": False}.items() <= terms.items()
    assert any(is_open and t.startswith("plomb") for t, is_open in terms.items())
    auto = toxicity.Automaton(sorted(terms.items()))
    texts = [stem + "zz9", long_word.upper(), long_word[:80] + long_word[81:], "Грубиян", "かき笨蛋くけ", "かき笨", "plain words", "蛋笨"]
    assert [len(h) for _, h in toxicity.find_hits(pa.array(texts), auto, {})] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert [toxicity.shorter("x" * n) for n in (4, 5, 32, 36, 40)] == ["x" * n for n in (3, 4, 31, 32, 36)]


def test_toxicity_reads_broken_utf8_and_context_beyond_wide_gaps(spark):
    auto = toxicity.Automaton([("grumbok", False)])
    raw = [b"a grumbok \xff\xfe", b"\xc3", b"\xa9 grumbok", b"grumbok", None, b""]
    column = pa.Array.from_buffers(pa.string(), 6, pa.array(raw, pa.binary()).buffers())
    assert [(n, len(h)) for n, h in toxicity.find_hits(column, auto, {})] == [(3, 1), (1, 0), (2, 1), (1, 1), (0, 0), (0, 0)]
    gap = " " * 5000
    assert [h[0][1] for _, h in toxicity.find_hits(pa.array([f'"{gap}grumbok{gap}"', f"quoted{gap}grumbok", f"grumbok{gap}grumbok"]), auto, {"quoted": -2.0})] == [True, True, False]
    docs = spark.createDataFrame([(1, bytearray(b"grumbok \xff"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) AS text")
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).first()["n_hits"] == 0


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(9)

    def text(i):
        w = prose(rng, 30).lower().split(" ")
        if i % 3 == 0:
            w[rng.randrange(5, 25)] = rng.choice(["grumbok", "zornfel", "grumbk", "zornfell", "snirk"])
        if i % 5 == 0:
            w[rng.randrange(5, 25)] = rng.choice(['"zornfel"', '"grumbok', "word grumbok"])
        return " ".join(w)

    docs = [(i, text(i)) for i in range(300)] + [(300, ""), (301, None), (302, "zornxfel and snrk"), (303, "word zornxfel " * 9)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    frame = table(spark, docs)
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    auto, context, weight, model = toxicity.learn(toxicity.teaching_rows(frame, labels, "doc_id", "text", 5, toxicity.SAMPLE_ROWS))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row

    def hit(word):
        found = []
        for t, (term, is_open) in enumerate(auto.terms):
            row = edits(word, term)
            best = min(edits(word[:i], term)[-1] for i in range(len(word) + 1)) if is_open else row[-1]
            if best == 0 or (best == 1 and len(term) >= toxicity.FUZZY_CHARS):
                found.append((best, t))
        return 2 * min(found)[1] + min(found)[0] if found else None

    assert auto.terms and hit("zornxfel") % 2 == 1
    for doc_id, t in docs:
        spans = [m.span() for m in re.finditer(r"[^\W_]+", (t or "").lower())]
        abuse = quote = n = 0.0
        for i, (a, b) in enumerate(spans):
            if (h := hit(t[a:b].lower())) is None:
                continue
            before = t[spans[i - 7][1] if i > 6 else 0 : a]
            after = t[b : spans[i + 7][0] if i + 7 < len(spans) else len(t)]
            marked = before.count('"') % 2 == 1 and '"' in after
            near = set(re.findall(r"\w+", (before + " " + after).lower()))
            if marked or sum(context.get(w, 0.0) for w in near) <= toxicity.QUOTED_AT:
                quote += weight[h]
            else:
                abuse += weight[h]
            n += weight[h] > 0
        x = [1.0, math.log1p(abuse), math.log1p(quote), min(1.0, 20 * n / max(1, len(spans)))]
        want = 1 / (1 + math.exp(-sum(u * v for u, v in zip(x, model, strict=True))))
        assert abs(got[doc_id]["score"] - want) < 1e-9, (doc_id, t)
        assert got[doc_id]["predicted"] == int(want >= 0.5)


def test_rarer_terms_beside_a_frequent_stem_are_kept():
    good = {w[:i]: 0 for w in ("moronic", "moroxyz") for i in range(4, 8)}
    good = {s: (sum(n for w, n in (("moronic", 100), ("moroxyz", 8)) if w.startswith(s)), 100 * (s == "moronic") + 8 * (s == "moroxyz")) for s in good}
    assert toxicity.choose_terms(good, set()) == [("moronic", False), ("moroxyz", False)]
    assert toxicity.choose_terms({"grum": (9, 0)}, {"grumbok", "xq"}) == [("grum", True), ("xq", False)]


def test_automaton_matches_edit_distance():
    terms = ["idiot", "stupid", "trash"]
    auto = toxicity.Automaton([(t, False) for t in terms])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(7)
    probes = {t for t in terms} | {"".join(rng.choice("idotsupra") for _ in range(rng.randint(3, 7))) for _ in range(300)}
    for t in terms:
        for i in range(len(t)):
            probes |= {t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "x" + t[i + 1 :], t[:i] + "xy" + t[i:]}
    for p in sorted(probes):
        ((_, hits),) = toxicity.find_hits(pa.array([p]), auto, {})
        best = min(distance(p, t) for t in terms)
        assert ([h % 2 for h, _ in hits] == [best]) if best <= 1 else not hits, p


def test_training_order(spark, rows, tmp_path):
    import base64

    import tiktoken

    df = training_order.training_order(table(spark, [*rows, (1, "a  b   c\n  d")]), length=16, shard_slots=10)
    got = sorted(df.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    assert all(r["shard"] == r["slot"] // 10 and r["shard_offset"] == r["slot"] % 10 * 32 for r in got)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(training_order.TOKENIZER, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in [*rows, (1, "a  b   c\n  d")]:
        ids = [*bpe.encode_ordinary(t or ""), training_order.EOS]
        for k in range(0, len(ids), 16):
            want[i, k // 16, tuple(ids[k : k + 16])] += 1
    assert Counter((r["doc_id"], r["seq_no"], tuple(np.frombuffer(r["tokens"], np.uint16)[: r["n_tokens"]].tolist())) for r in got) == want
    again = training_order.training_order(table(spark, rows[::-1] + [(1, "a  b   c\n  d")]).repartition(3), length=16, shard_slots=10)
    assert {(r["slot"], bytes(r["tokens"])) for r in again.collect()} == {(r["slot"], bytes(r["tokens"])) for r in got}
    uri = f"file://{tmp_path}/shards"
    assert training_order.write_shards(df, uri).agg(F.sum("n_slots")).first()[0] == len(got)
    assert training_order.write_shards(df, uri, key=1).count() == -(-len(got) // 10)  # again, over what is there
    read = training_order.read_slots(uri, 7, 23)
    assert read.tobytes() == b"".join(bytes(r["tokens"]) for r in got[7:23])
    assert training_order.training_order(table(spark, [])).count() == 0


def test_training_order_deals_by_bytes_and_reads_broken_utf8(spark, monkeypatch):
    monkeypatch.setattr(training_order, "OUTPUT_BYTES", 100)
    broken = spark.createDataFrame([(1, bytearray(b"a \xff b")), (2, bytearray(b"ok")), (3, None)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) AS text")
    repaired = table(spark, [(1, "a \ufffd b"), (2, "ok"), (3, None)]).select("doc_id", "text")
    got, want = ({(r["slot"], r["doc_id"], bytes(r["tokens"])) for r in training_order.training_order(d, length=8).collect()} for d in (broken, repaired))
    assert got == want and len(got) == 3
    rows = [(i, f"text {i} " * 10) for i in range(60)]
    out = training_order.training_order(table(spark, rows), length=8, shard_slots=4)
    parts = out.select("slot", "shard", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in parts}) > 10 and len({(r["p"], r["shard"]) for r in parts}) == len({r["shard"] for r in parts})
    assert [r["slot"] for r in sorted(parts)] == list(range(len(parts)))


def test_broadcasts_are_checked_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(_spark, "BROADCAST_BYTES", 100)
    hinted = lambda rows: "broadcast" in _spark.sized(spark.createDataFrame(rows, "k string, n long"))._jdf.queryExecution().logical().toString().lower()
    assert hinted([("a" * 50, 1), (None, 2)]) and not hinted([("a" * 50, 1), ("b" * 51, 2)])


def test_class_lm_scores_match_brute_force(spark, rows, monkeypatch):
    """With the classes it learned, the table of class bigrams and each score are those of a loop over tokens."""
    seen = {}
    learn = class_lm.learn_classes

    def recorded(*given):
        seen["out"] = learn(*given)
        return seen["out"]

    monkeypatch.setattr(class_lm, "learn_classes", recorded)
    got = class_lm.score_texts(table(spark, rows)).collect()
    cls, bigrams, _ = seen["out"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [words(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)

    def coded(w):
        raw = np.frombuffer(w, np.uint8)
        a, b = np.array([0]), np.array([len(raw)])
        return int(T.word_hashes(raw, a, b).view(np.int64)[0]), int(class_lm.endings(raw, a, b)[0])

    code = {w: coded(w) for _, t in rows for w in words(t)}
    own = sorted((w for w, n in count.items() if n >= class_lm.MIN_COUNT), key=lambda w: (-count[w], code[w][0]))
    unit = {w: len(own) + e for w, (_, e) in code.items()} | {w: k for k, w in enumerate(own)}
    end = len(cls) - 1
    assert len(cls) == len(own) + class_lm.ENDINGS + 1
    path = lambda t: [int(cls[u]) for u in (end, *(unit[w] for w in t), end)]
    want = Counter(pair for t in train for pair in zip(path(t)[:-1], path(t)[1:], strict=True))
    assert {(a, b): bigrams[a, b] for a, b in zip(*np.nonzero(bigrams), strict=True)} == want
    of_class, kinds = Counter(), Counter(int(cls[unit[w]]) for w in count)
    for (_, b), n in want.items():
        of_class[b] += n
    before = Counter()
    for (a, _), n in want.items():
        before[a] += n
    total = sum(of_class.values())

    def score(t):
        k, out = path(t), 0.0
        for i, w in enumerate([*t, None]):
            a, b = k[i], k[i + 1]
            share = (of_class[b] + 1) / (total + class_lm.CLASSES)
            out += math.log10((want[a, b] + class_lm.PRIOR * share) / (before[a] + class_lm.PRIOR))
            if w is not None:
                out += math.log10((count[w] + class_lm.ADD) / (of_class[b] + class_lm.ADD * (kinds[b] + 1)))
        return out

    scores = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in got)
    assert scores == Counter((i, len(words(t)) + 1, round(score(words(t)), 5)) for i, t in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(training_order.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def brute_cost(roles):
    best = math.inf
    for target in product((1, 2, 3), repeat=len(roles)):
        cost, before = 0.0, 0
        for r, a in zip(roles, target, strict=True):
            cost += chat_repair.move(before, r, a)
            before = a
        best = min(best, cost + 3.0 * len(chat_repair.CLOSING[before]))
    return best


def test_chat_repair(spark):
    rng = random.Random(3)
    names = {0: "robot", 1: " System", 2: "user", 3: "ASSISTANT"}
    convs = {i: [rng.choice([0, 1, 2, 2, 3, 3]) for _ in range(rng.randint(1, 7))] for i in range(40)}
    convs[99] = [2, 3] * 300
    rows = [(i, k, names[r] if (i + k) % 9 else (None if r == 0 else names[r]), f"m{k}", "x") for i, rs in convs.items() for k, r in enumerate(rs)]
    rows += [(None, 0, "user", None, "x"), (None, 0, "user", None, "x")]
    got = chat_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")).collect()
    assert len(got) == len(rows)
    for i, rs in convs.items():
        mine = sorted((r for r in got if r["conv_id"] == i), key=lambda r: r["position"])
        assert mine[0]["conv_cost"] == (brute_cost(rs) if len(rs) < 9 else 0.0)
        text = "".join(r["rendered"] for r in mine)
        roles = __import__("re").findall(r"<\|(system|user|assistant)\|>", text)
        assert roles[-1] == "assistant" and text.endswith("<|end|>\n") and text.count("<|end|>") == len(roles)
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2)
        assert [m for m in __import__("re").findall(r"m\d+", text)] == [f"m{k}" for k in range(len(rs))]
    whole = {r["conv_id"]: r["conversation"] for r in chat_repair.rendered_chunks(spark.createDataFrame(got)).collect()}
    assert whole[99] == "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 99), key=lambda r: r["position"]))
    assert chat_repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out


def test_words_and_passages_that_collide_under_sums_of_powers_are_told_apart(spark):
    a = thue_morse(2048)
    b = a.translate({97: "b", 98: "a"})
    raw, off = T.utf8(pa.array([f"{a} {b} {a[:400]} {b[:400]} {a} {a[:400]} abcdefgh abcdefghi"]))
    start, end, _ = T.words(raw, off)
    h = T.word_hashes(raw, start, end).tolist()
    assert len(set(h)) == 6 and h[0] == h[4] and h[2] == h[5]
    docs = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, f"{a} one"), (4, f"{b} two")]
    assert {r["component_id"] for r in near_dedup.near_duplicates(table(spark, docs)).collect()} == {1, 2, 3, 4}
    got = {r["doc_id"]: r["n_known"] for r in class_lm.score_texts(table(spark, [(1, a), (2, a), (9, b)])).collect()}
    assert got[9] == 2 and zlib.crc32(b"9") % 10  # 9 trains as well, so its word is known by itself
    cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(table(spark, docs)).collect()}
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        assert cut[i] == gone.sum()


def test_chat_repair_of_a_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    roles = [rng.choice([0, 2, 3, 3]) for _ in range(900)]
    names = ["?", "system", "user", "assistant"]
    rows = [(7, k, names[r], "a <|end|> <\\|user|> é" if k == 5 else None if k == 6 else "x" * 3000 if k == 8 else f"m{k}") for k, r in enumerate(roles)]
    rows += [(i, k, "user", "z") for i in (1, 2, 9) for k in range(3)] + [(None, None, None, None), (None, 1, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = []
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(repr, chat_repair.repair_conversations(frame.repartition(int(parts))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert results[0] == results[1] and len(results[0]) == len(rows)
    mine = sorted((r for r in chat_repair.repair_conversations(frame).collect() if r["conv_id"] == 7), key=lambda r: r["position"])
    assert [r["position"] for r in mine] == list(range(900))
    state, cost = chat_repair.repaired(np.array(roles), np.array([0, 900]), np.array([0]), np.array([-1]))
    best = {0: 0.0}
    for r in roles:
        best = {a: min(c + chat_repair.move(b, r, a) for b, c in best.items()) for a in (1, 2, 3)}
    best = min(c + chat_repair.CLOSE[a] for a, c in best.items())
    assert cost[0] == best == mine[0]["conv_cost"] and [names[s] for s in state] == [r["new_role"] for r in mine]
    text = "".join(r["rendered"] for r in mine)
    assert "a <\\|end|> <\\\\|user|> é" in text
    turns = __import__("re").findall(r"<\|(system|user|assistant)\|>\n", text)
    body = turns[turns[0] == "system" :]
    assert body == ["user", "assistant"] * (len(body) // 2) and text.count("<|end|>") == len(turns)
    copies = spark.createDataFrame([(1, 1, "user", "a", 5, "q")] * 3, "conv_id long, turn long, role string, text string, part int, open string")
    assert [r["action"] for r in chat_repair.repair_conversations(copies).orderBy("position").collect()] == ["keep", "merge", "relabel"]


def test_secrets_of_a_very_long_text_take_linear_time(spark):
    """A text of 5 MB with 50,000 base spans and as many bare tokens."""
    import time

    value = "hunter22x9abcd"
    long = "".join(f"password={value} w{i} plain {value} and {'z' * 60} " for i in range(50_000))
    start = time.time()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(table(spark, [(1, long), (2, "nothing"), (3, f"x {value}")])).collect()}
    assert len(long) > 5_000_000 and time.time() - start < 30
    assert (got[1]["n_assign"], got[1]["n_added"], got[1]["n_live"]) == (50_000, 50_000, 50_000) and got[3]["spans"] == "owned:2:16"
    ends = [int(x.split(":")[2]) for x in got[1]["spans"].split(",")]
    assert all(long[e - len(value) : e] == value for e in ends) and len(set(ends)) == 100_000


def test_secrets_that_look_like_placeholders_or_repeat_are_not_live(spark):
    rows = [(1, "token=xxxx1111"), (2, "token=my_example_99"), (3, "token=q7Gz0Lk2pW"), (4, "bare q7Gz0Lk2pW my_example_99 xxxx1111")]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert [got[i]["n_live"] for i in (1, 2, 3)] == [0, 0, 1] and got[4]["spans"] == "owned:5:15"


def test_toxicity_learns_the_words_of_quotation(spark):
    rng = random.Random(12)
    bad, calm = "grumbok", "murmuration"
    rows = [(f"{prose(rng, 20)} {bad} {prose(rng, 9)} {bad} {prose(rng, 20)}", 1) for _ in range(150)]
    rows += [(f"{prose(rng, 20)} {calm} {bad} {prose(rng, 25)}", 0) for _ in range(30)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    auto = toxicity.Automaton([(bad, False)])
    weights = toxicity.context_weights(frame, auto)
    assert weights[calm] == -2.0 and weights["said"] == -2.0 and bad not in weights
    ((_, hits),) = toxicity.find_hits(pa.array([f"they {calm} {bad} x y z a b c d {bad}"]), auto, weights)
    assert [q for _, q in hits] == [True, False]


def test_toxicity_of_very_long_texts_and_repeated_ids(spark):
    """5 MB with 50,000 hits take linear time; an id of many rows teaches no more than the bound."""
    import time

    rng = random.Random(4)
    docs = [(i, f"{prose(rng, 30)} {'grumbok grumbok' if i % 3 == 0 else ''} {prose(rng, 9)}") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    long = f"{prose(rng, 40)} grumbok " * 50_000
    start = time.time()
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, [*docs, (1000, long), (1001, None), (1002, "x" * 5_000_000)]), labels).collect()}
    assert time.time() - start < 60 and len(long) > 5_000_000
    assert got[1000]["n_hits"] == 50_000 and got[1000]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    many = table(spark, [(7, f"{i} {prose(rng, 5)}") for i in range(200)])
    assert toxicity.teaching_rows(many, spark.createDataFrame([(7, 1)], "doc_id long, toxic int"), "doc_id", "text", 5, 50).count() == 50
    again = table(spark, [(7, "same")] * 60)
    assert toxicity.teaching_rows(again, spark.createDataFrame([(7, 1), (7, None), (None, 1)], "doc_id long, toxic int"), "doc_id", "text", 5, 50).count() == 1
    assert toxicity.toxicity(table(spark, []), labels).count() == 0


def test_training_order_does_not_depend_on_settings_and_splits_rows_without_id(spark):
    rows = [(None, f"t{i} x") for i in range(40)] + [(i % 5, "same " * 30) for i in range(20)] + [(9, "a \xa0 \xa0 b")]
    found = []
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = training_order.training_order(table(spark, rows).repartition(int(parts)), length=8, shard_slots=4)
        found.append({(r["slot"], r["doc_id"], r["seq_no"], bytes(r["tokens"])) for r in df.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert found[0] == found[1] and sorted(x[0] for x in found[0]) == list(range(len(found[0])))
    encoder = training_order.Encoder(open(training_order.TOKENIZER, "rb").read(), np.uint16)
    assert encoder.encode("a \xa0 \xa0 b") == encoder.one("a \xa0 \xa0 b")


@pytest.mark.parametrize("n", [1, 2, 6, 20])
def test_mixing_targets_match_resharing_in_a_loop(spark, n):
    rng = random.Random(n)
    totals = [rng.choice([0, 1270, 1320, rng.randint(20_000, 23_000), rng.randint(1, 10**6)]) for _ in range(n)]
    if n == 6:
        totals = [1270, 1320, 1290, 1300, 1310, 1280]
    names = [None if n > 2 and i == n - 1 else f"s{i:02d}" for i in range(n)]
    df = spark.createDataFrame([(x is None, x or "", t) for x, t in zip(names, totals, strict=True)], "no_source boolean, source string, total long")
    got = {None if r["no_source"] else r["source"]: r["target"] for r in mixing.source_targets(df, [3.0, 1.0, 2.0], 1.5, 2).collect()}
    weight = {x: [3.0, 1.0, 2.0][i % 3] for i, x in enumerate(names)}
    cap = {x: 2.0 * t for x, t in zip(names, totals, strict=True)}
    full: set = set()
    while True:
        free = [x for x in names if x not in full]
        level = (1.5 * sum(totals) - sum(cap[x] for x in full)) / sum(weight[x] for x in free) if free else 0.0
        more = {x for x in free if level * weight[x] > cap[x]}
        if not more:
            break
        full |= more
    for x in names:
        assert got[x] == pytest.approx(cap[x] if x in full else level * weight[x])
        assert 0 <= got[x] <= cap[x] + 1e-6
    assert sum(got.values()) == pytest.approx(1.5 * sum(totals))


@pytest.mark.parametrize(("dims", "threshold"), [(2, 0.98), (3, 0.9), (64, 0.8), (300, 0.9)])
def test_near_vectors_reach_their_recall_at_any_dimension_and_threshold(spark, dims, threshold):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(100, dims))
    near = threshold + (1 - threshold) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    x = np.concatenate((x, near * x + math.sqrt(1 - near**2) * y / np.linalg.norm(y, axis=1)[:, None]))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), threshold=threshold).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= threshold).sum() - len(x)
    assert 0.99 * want <= sum(got.values()) <= want


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_a_text_of_new_words_is_encoded_at_once(kind):
    encoder = training_order.Encoder(open(training_order.TOKENIZER, "rb").read(), kind)
    text = " ".join(f"word{i}x{i * 7919}" for i in range(300)) + "\n \tend "
    want, calls, plain = encoder.one(text), [], encoder.bpe.encode_ordinary
    encoder.bpe.encode_ordinary = lambda t: calls.append(t) or plain(t)
    assert encoder.encode(text) == want
    assert calls == [text]
