import random
import re

import pytest

from tracewright.llm import op08_spaced_seeds as op


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    """(doc, item) with a window of 13 words (or the item) that agrees in 80 %, at any shift."""
    out = set()
    for d, t in docs:
        a = tokens(t)
        for i, u in items:
            b = tokens(u)
            size = min(op.WINDOW, len(b))
            if len(b) < op.MIN_WORDS:
                continue
            for x in range(len(a) - size + 1):
                for y in range(len(b) - size + 1):
                    if sum(p == q for p, q in zip(a[x : x + size], b[y : y + size])) * 100 >= 80 * size:
                        out.add((d, i))
    return out


@pytest.mark.parametrize("seed,block", [(1, 500_000), (2, 150)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    r = random.Random(seed)
    vocab = ["The", "of", "and"] * 6 + [f"W{i}é" for i in range(120)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([4, 5, 6, 8, 13, 30])))) for i in range(25)] + [(100, None), (101, "")]
    docs = [(0, None), (1, ""), (2, "W1é")]
    for d in range(3, 120):
        body = text(r.randint(0, 60))
        if r.random() < 0.6:
            piece = tokens(r.choice(items[:25])[1])
            piece = piece[r.randint(0, len(piece) // 3) :]
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                piece[r.randrange(len(piece))] = "ZZZ"
            at = r.randint(0, len(body))
            body[at:at] = piece
        docs.append((d, "\n ".join(body)))
    want = brute(docs, items)
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, item_id long, n_agree int")
    bench = spark.createDataFrame([(*x, "d") for x in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id) for x in op.find_overlaps(df, bench).collect()}
    assert got == want and len(want) > 20
    clean = op.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_planted_with_one_substitution_in_six(spark):
    item = " ".join(f"item{i}" for i in range(40))
    hit = " ".join("other" if i % 6 == 3 else f"ITEM{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + hit + " c"), (1, "clean words here"), (None, hit)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in op.find_overlaps(docs, bench).collect()) == ["1", "None"]
    assert [r.text for r in op.decontaminate(docs, bench).collect()] == ["clean words here"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert op.find_overlaps(none, bench).collect() == []
    assert op.find_overlaps(docs, bench.limit(0)).collect() == []
    assert op.decontaminate(docs, bench.limit(0)).count() == 1 and op.decontaminate(none, bench).count() == 0
