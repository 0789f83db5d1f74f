"""The Merkle manifest, vector codes and nearest neighbours against brute force, on odd rows as well."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import ann, manifest, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proof_of(nodes, i):
    """(last node, siblings level by level) of place i."""
    path = []
    while len(nodes) > 1:
        a = i // 8 * 8
        path.append((nodes[a:i], nodes[i + 1 : a + 8]))
        nodes, i = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], i // 8
    return nodes[0], path


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    out = []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(out)
            out.append({"doc_id": rng.choice([i, i, i, 1000 + i]), "text": rng.choice(["", None, f"Abc É {i}", "x " * 300 + str(i)]), "lang": lang, "source": rng.choice([None, "S", "s:1"]), "n_chars": rng.choice([None, i]), "leaf": "clash", "pos": 1, "grp": "z"})
    if len(out) > 1:
        out += [out[0], out[0], dict(out[1], doc_id=None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 70, None: 9, "é": 1, "de": 8, "": 2, "Z": 1}, {f"l{i}": 1 + i % 3 for i in range(20)}], ids=["one", "six", "twenty"])
def test_manifest(spark, sizes):
    rows = rows_of(sizes)
    got = manifest.verified_rows(spark.createDataFrame([tuple(r.values()) for r in rows], DOCS)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    leaves = {x: [leaf_of(r) for r in by[x]] for x in langs}
    subroots = [proof_of(leaves[x], 0)[0] for x in langs]
    want = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = proof_of(leaves[x], i)[1] + proof_of(subroots, k)[1]
            root = proof_of(subroots, k)[0]
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            at = leaf_of(r, bad)
            for a, z in path:
                at = H(*a, at, *z)
            want.append((str(r["doc_id"]), leaf_of(r), subroots[k], root, H(*(d for a, z in path for d in [*a, *z])), at, at == root))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want)
    assert not all(r["verified"] for r in got) or len(rows) < 5


def test_manifest_of_nothing_and_of_other_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert manifest.verified_rows(empty).count() == 0
    odd = spark.createDataFrame([("b", "X"), ("a", None)], "doc_id string, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in manifest.verified_rows(odd).collect()} == {"a", "b"}


def test_proofs_of_a_few_requests_equal_those_of_all(spark):
    rows = rows_of({"en": 90, "de": 1, "fr": 9})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).select("doc_id", "lang", manifest.packed(manifest.digest(manifest.framed(F.col("text")), manifest.framed(F.col("doc_id")))).alias("leaf"))
    m = manifest.build(df, "lang", ["doc_id", "leaf"])
    every = {(r["grp"], r["pos"]): (r["leaf"], r["path"]) for r in manifest.proofs(m, ["grp", "pos"]).collect()}
    some = m.leaves.where("pos % 7 = 3 or depth = 0")
    few = manifest.proofs(m, ["grp", "pos"], some).collect()
    assert len(few) == some.count() and all(every[r["grp"], r["pos"]] == (r["leaf"], r["path"]) for r in few)
    assert manifest.proofs(m, ["grp", "pos"]).where(manifest.fold(manifest.text_of(F.col("leaf")), F.col("path")) != m.root).count() == 0


def codes_by_hand(vectors, width):
    """(codes, errors, books) of integer vectors in the order of their ids."""
    w = width // 4
    books = [[list(v[p * w : p * w + w]) for v in vectors[:256]] for p in range(4)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for v in vectors:
                own[assign(v, p)[1]].append(v[p * w : p * w + w])
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[assign(v, p) for p in range(4)] for v in vectors]
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


VECS = "vec_id long, embedding array<float>, label string, code string, v int"


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.01, 1.0])], rng.choice(["a", "b", None]), "clash", 1) for i in rng.permutation(330) - 20]
    data += [(400 + i, data[0][1], None, "c", 2) for i in range(4)]
    odd = [(900, None, "a", "c", 1), (901, [1.0] * 7 + [None], "a", "c", 1), (902, [math.nan] * 8, "a", "c", 1), (903, [math.inf] * 8, "b", "c", 1)]
    got = {r["vec_id"]: r for r in vector_codes.compressed(spark.createDataFrame(data + odd, VECS)).collect()}
    data.sort(key=lambda r: r[0])
    whole = [[math.floor(1024 * x) for x in r[1]] for r in data]
    codes, errors, books = codes_by_hand(whole, 8)
    total = defaultdict(int)
    for r, e in zip(data, errors, strict=True):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert len(got) == len(data)
    for r, c, e in zip(data, codes, errors, strict=True):
        assert tuple(got[r[0]])[1:] == (c, e, total[r[2]], digest)


def test_vector_codes_of_few_short_and_huge_vectors(spark):
    make = lambda rows: vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert make([]).count() == 0
    assert make([(1, None, 1)]).count() == 0
    few = {r["vec_id"]: r for r in make([(1, [0.5, 1.0, 2.0], 1), (2, [], 1), (3, [1e300, -1e300, 0.0, 1.0], None), (None, [0.5, 1.0, 2.0], 1)]).collect()}
    assert few[1]["code"] == few[None]["code"] and few[1]["error"] == 0 and len(few) == 4


def test_slices_find_the_first_of_equally_near_entries():
    rng = np.random.default_rng(1)
    book = rng.integers(-5, 6, (256, 6))
    x = rng.integers(-9, 10, (700, 6))
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, best = vector_codes.Slices(book).nearest(x)
    assert (best == apart.min(axis=1)).all() and (index == apart.argmin(axis=1)).all()


def best_by_hand(rows, k=20, every=20):
    """All candidates of each query by product (added in order) and id."""
    out = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and i % every == 0 and v is not None:
            s = [(-sum_in_order(v, w), j is None, j or 0, j) for m, (j, w) in enumerate(rows) if m != n and w is not None and len(w) == len(v)]
            out[n] = sorted(s)[:k]
    return out


def sum_in_order(v, w):
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += a * b
    return total


def test_nearest_reaches_its_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24)) * np.exp(0.5 * rng.normal(size=(900, 1)))
    x[100:160] = x[100]  # copies: ties go to the smaller id
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(900), x, strict=True)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, row int, score double")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    hit = total = 0
    for n, want in best_by_hand(rows).items():
        mine = got[rows[n][0]]
        assert len(mine) == 20 and mine == sorted(mine) and len(set(mine)) == 20
        known = {(s, j) for s, _, _, j in best_by_hand([rows[n], *(r for r in rows if r[0] in {j for _, j in mine})], 20)[0]}
        assert set(mine) <= known
        hit, total = hit + len({(s, j) for s, _, _, j in want} & set(mine)), total + 20
    assert hit / total >= 0.95


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [math.nan, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 5.0]), (5, [1.0, 0.0, 0.0]), (80, []), (100, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 3, 2.0), (0, 2, 7, 1.0), (0, 3, 7, 1.0), (0, 4, None, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_windows_hold_what_they_should():
    assert ann.least_collisions() < ann.LINES
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    index = ann.Index(x)
    for q in x[:20]:
        some, score, seen = index.search(q, -1, 5)
        assert np.array_equal(score, ann.products(x[some], q)) and 5 <= seen <= 300


@pytest.mark.parametrize("n", [1, 70, 66_000])
def test_collisions_are_lines_whose_windows_hold_a_vector(n):
    rng = np.random.default_rng(n)
    x, q = rng.normal(size=(n, 3)), rng.normal(size=(2, 3))
    index = ann.Index(x, lines=5)
    point = np.c_[index.unit, np.sqrt(np.maximum(index.most**2 - (index.unit**2).sum(axis=1), 0))] @ index.lines
    for i, (lows, highs) in enumerate(zip(*index.windows(q), strict=True)):
        at = q[i] / np.linalg.norm(q[i]) * index.most @ index.lines[:-1]
        for radius, low, high in zip(index.radii, lows, highs, strict=True):
            assert (np.abs(index.collisions(low, high) - (np.abs(point - at) <= radius).sum(axis=1)) <= (np.abs(np.abs(point - at) - radius) < 1e-9).sum(axis=1)).all()
