import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import op01_lexicon_bpe as bpe

import test_op05
import test_op08


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"word{i}é" for i in range(900)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, line(20)) for i in range(3)]
    shared = "\n".join(line(6) for _ in range(30))
    docs = {d: "\n".join(line(12) for _ in range(5)) for d in range(40)}
    docs[40] = docs[3].replace(docs[3].split()[7], "changed", 1)
    docs[41] = docs[3]
    docs[42] = docs[5] + "\n" + items[1][1]
    docs[43], docs[44] = docs[6] + "\n" + shared, shared + "\n" + line(30)
    docs[45], docs[46], docs[47] = "too short", None, "a b c d e f " * 20
    return docs, items


def rows(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:k]:
        docs = stage(spark, docs, sf)
    return docs


def test_stages(spark, tmp_path):
    docs, items = corpus(1)
    sf = str(tmp_path)
    data = [(d, t, "en", "src0", len(t or "")) for d, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns

    kept = rows(spark, sf, 1)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(docs) - {45, 46, 47}
    cut = {r.doc_id: r for r in rows(spark, sf, 2).collect()}
    assert set(cut) == set(docs) - {45, 46, 47} and all(r.n_chars == len(r.text) for r in cut.values())
    assert len(cut[44].text) < len(docs[44]) and cut[43].text == docs[43] and cut[3].text == docs[3]
    near = {r.doc_id: r.text for r in rows(spark, sf, 3).collect()}
    want = test_op05.brute([(d, r.text) for d, r in cut.items()], k=5)
    assert set(near) == {d for d, (_, _, keep) in want.items() if keep}
    clean = {r.doc_id: r.text for r in rows(spark, sf, 4).collect()}
    assert set(clean) == set(near) - {d for d, _ in test_op08.brute(list(near.items()), items)} and 42 in near and 42 not in clean

    t = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    for d, text in clean.items():
        ids = t.encode(text, add_special_tokens=False).ids
        whole = hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[d] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), whole)
    assert set(got) == set(clean)
