import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewright.llm import op01_lexicon_bpe as op

PATH = op.default_path()
TEXTS = [
    None, "", " \n\t", "Hello, world's best!! It's 2024 ÀÉÎ l'été", "<|startoftext|>a<|endoftext|> b <|endoftext", "x" * 5000, "éá ﬁ Σίσυφος ΑΣ ẞ İ", "日本語 テスト 🙂🙂 ½ ²x",
    "a\u0085b c\x1cd\x1fe​f　g", "<|a|> \0x\0", "don't DON'T we'll'd''re", "a_b-c/d 12x34", "\u0000", "ﷺ" * 3,
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    out = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return out, [t.decode(i, skip_special_tokens=False) for i in out]


def test_every_common_character():
    t, own = Tokenizer.from_file(PATH), op.tokenizer(PATH)
    for c in map(chr, range(0x260)):
        for text in (f"ab{c}cd", f"1{c}{c}'s", c):
            ids = t.encode(text, add_special_tokens=False).ids
            assert [i for w in own.words(text) for i in own.merge(w)] == ids, hex(ord(c))


def test_merges_like_the_library():
    r, t, own = random.Random(1), Tokenizer.from_file(PATH), op.tokenizer(PATH)
    for _ in range(3000):
        word = "".join(r.choice("abcdefghinorstuéñ") for _ in range(r.randint(1, 30)))
        assert own.merge(word) == t.encode(word, add_special_tokens=False).ids


def test_lexicon(tmp_path):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(500)} | {"é", "éa"})
    kept = words[::2]
    (tmp_path / "x").write_bytes(op.compile_lexicon([(w, [i, i + 1]) for i, w in enumerate(kept)]))
    lex = op.Lexicon(str(tmp_path / "x"))
    numbers = lex.numbers([w.encode() for w in [*words, "zzz", "a" * 50]])
    for w, k in zip([*words, "zzz", "a" * 50], numbers):
        assert (k >= 0) == (w in kept)
        if k >= 0:
            assert list(lex.ids[lex.first[k] : lex.first[k + 1]]) == [kept.index(w), kept.index(w) + 1]
    assert len(lex.final) < 150  # suffixes are shared


@pytest.mark.parametrize("size", [1, 20, 65536])
def test_round_trip(spark, size):
    rows = [(i if i else None, t, "clash", b"z") for i, t in enumerate(TEXTS + TEXTS[3:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe_text string, ids binary")
    out = op.encode(docs, decoded=True, lexicon_size=size)
    ids, decoded = library([r[1] for r in rows])
    want = sorted((str(r[0]), np.asarray(i, "<u4").tobytes(), d) for r, i, d in zip(rows, ids, decoded))
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in out.collect()) == want
    back = op.decode(out)
    assert sorted(r.decoded for r in back.collect()) == sorted(decoded)


def test_empty_table(spark):
    assert op.encode(spark.createDataFrame([], "doc_id long, text string"), decoded=True).collect() == []


def test_query(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    ids, decoded = library(docs.text.tolist())
    want = {d: (len(i), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in zip(docs.doc_id, ids, decoded)}
    assert {r.doc_id: tuple(r)[1:] for r in op.op1_lexicon_bpe(spark, sf).collect()} == want


def test_plain_texts_load_no_library():
    bpe = op.WordBpe(PATH)
    assert bpe.words("Plain text, l'été") and "_library" not in vars(bpe)
    assert bpe.words("日本語") and "_library" in vars(bpe)


def test_memory_is_released_as_a_task_ends(monkeypatch):
    from tracewright.llm import memory

    done = []
    monkeypatch.setattr(memory, "release", lambda: done.append(1))
    rows = memory.freed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not done and list(rows) == [3] and done == [1]
