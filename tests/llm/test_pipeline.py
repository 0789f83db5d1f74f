"""The pipeline's stages take effect one after the other."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tidebar.llm import training_order


def test_stages(spark, tmp_path):
    texts = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(60)}
    texts[60] = texts[3]
    texts[61] = " ".join(f"q{k}" for k in range(20)) + " " + texts[4]
    for i in range(0, 40, 2):
        texts[i] = texts[i] + f" grumbok w{i} " + ("grumbok" if i else "")
    docs = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grumbok" in t)) for i, t in texts.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = set(texts)
    gone = [{i for i, t in texts.items() if "grumbok" in t}, {60}, {61}]
    for (_, stage), bad in zip(corpus_pipeline.STAGES, gone, strict=False):
        frame = stage(spark, frame, str(tmp_path)).cache()
        left -= bad
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in frame.collect()} == left
    mixed = corpus_pipeline.STAGES[3][1](spark, frame, str(tmp_path))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= left and max(copies.values()) == 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    assert Counter(r["doc_id"] for r in out if r["seq_no"] == 0) == copies
    assert all(np.frombuffer(r["tokens"], np.uint16)[r["n_tokens"] - 1] == training_order.EOS for r in out)


def test_stages_handle_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, empty tables, and columns named as an operator's or with dots."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, `a.b` string, c1 long"
    a, b = " ".join(f"u{k}" for k in range(50)), " ".join(f"v{k}" for k in range(9000))
    texts = [(1, a), (1, a), (1, a), (2, None), (3, ""), (None, a), (None, a), (None, "no id"), (4, b), (5, a + " z"), (6, " ".join(f"q{k}" for k in range(20))), (7, "p " * 3), (7, "other rows")]
    docs = spark.createDataFrame([(i, t, None, None if i is None else "s", None, "mine", "big", "dot", 9) for i, t in texts], schema)
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"q{k}" for k in range(20))), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [Counter(texts), Counter([(1, a), (2, None), (3, ""), (None, a), (None, "no id"), (4, b), (6, texts[10][1]), (7, "p p p "), (7, "other rows")])]
    want.append(want[1] - Counter([texts[10]]))
    frame = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert frame.schema.simpleString() == docs.schema.simpleString(), name
        got = frame.collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == rows, name
        assert {(r["score"], r["size"], r["a.b"], r["c1"]) for r in got} == {("mine", "big", "dot", 9)}
    mixed = corpus_pipeline.STAGES[3][1](spark, frame, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} <= set(want[2]) and {r["score"] for r in mixed} == {"mine"}
    again = corpus_pipeline.STAGES[3][1](spark, frame.repartition(3), str(tmp_path)).collect()
    assert Counter(map(str, mixed)) == Counter(map(str, again))
    out = corpus_pipeline.STAGES[4][1](spark, frame, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out if r["seq_no"] == 0) == Counter(i for i, _ in want[2].elements())
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, nothing, str(tmp_path))
        assert got.count() == 0, name
