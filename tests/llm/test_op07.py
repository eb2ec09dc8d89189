import zlib

import numpy as np
import pandas as pd

from tracewright.llm import op07_kernel_langid as op


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    rows = op.op7_kernel_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs.lang[r.doc_id] for r in unseen]) > 0.97


def test_edges(spark):
    rows = [(i, t, lang, 1, 2) for i, (t, lang) in enumerate([("abc def", "x"), ("xyz uvw", "y"), ("abc ghi", "x"), ("xyz xyz", "y")] * 10)]
    schema = "doc_id long, text string, lang string, score int, held_out int"
    docs = spark.createDataFrame([*rows, (None, "abc", None, 1, 2), (100, None, None, 1, 2), (101, "123 !", "x", 1, 2), (102, "", None, 1, 2), (103, "abc " * 700_000, None, 1, 2)], schema)
    model = op.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in op.identify(docs, model).collect()}
    assert {(None, "x"), (100, "und"), (101, "und"), (102, "und"), (103, "x")} <= got and len(got) == 45
    assert all(dict(got)[i] == ("x" if i % 2 == 0 else "y") for i in range(40))
    empty = docs.limit(0)
    assert op.train(empty) is None and op.identify(empty, None).collect() == []
    assert {r.lang_pred for r in op.identify(docs, None).collect()} == {"und"}


def test_slices_agree(monkeypatch):
    text = "Ab cé, de! fgh " * 50
    whole = op.presence(text)[0]
    monkeypatch.setattr(op, "SLICE", 17)
    assert (op.presence(text)[0] >= whole).mean() == 1.0


def test_every_language_is_learned(spark, monkeypatch):
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    words = {f"l{k:03}": " ".join(word() for _ in range(6)) for k in range(230)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(list(words.items()) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.train(docs)
    assert model.languages == sorted(words) and len(model.bits) >= len(words)
    assert all(x.lang_pred == rows[x.doc_id][2] for x in op.identify(docs, model).collect())
    monkeypatch.setattr(op, "TRAIN_ROWS", 100)
    assert op.train(docs).languages == sorted(words)
