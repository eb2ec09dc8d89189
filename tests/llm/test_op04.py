import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import op04_runindex as op

SCHEMA = "doc_id long, text string, kept string, rid long, removed int"


def brute(texts, width):
    """Removed spans and kept bytes by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed, alphabet="abé "):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [word(r.randint(60, 400)) for _ in range(6)]
    texts = [None, "", "x", "ab" * 150, "ab" * 150, "a" * 260, "a" * 199]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            s = r.choice(shared)
            kind = r.random()
            if kind < 0.3:
                parts.append(word(r.randint(1, 300)))
            elif kind < 0.6:
                parts.append(s)
            elif kind < 0.8:
                parts.append(s[r.randint(0, 50) :])
            else:
                i = r.randrange(len(s))
                parts.append(s[:i] + "Z" + s[i + 1 :])
        texts.append("".join(parts))
    return texts + texts[-3:]


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 2000), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(op, "HOT", hot)
    texts = corpus(seed)
    rows = [(i if i % 9 else None, t, "clash", 1, 2) for i, t in enumerate(texts)]
    got = op.remove_long_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((r[0], *b[:2], b[2], b[3]) for r, b in zip(rows, brute(texts, 200)))
    have = Counter((g.doc_id, g.n_bytes, sum(x.e - x.s for x in g.removed or []), len(g.removed or []), bytes(g.kept)) for g in got)
    assert have == want


def test_long_text_by_pieces(spark):
    r = random.Random(5)
    body = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    texts = [body, "x" + body[250_000:520_000] + "y", "tail"]
    got = {g.doc_id: g for g in op.remove_long_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(x.s, x.e) for x in got[0].removed] == [(250_000, 520_000)]
    assert bytes(got[1].kept) == b"xy" and bytes(got[2].kept) == b"tail"


def test_empty_table(spark):
    assert op.remove_long_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_matches_brute_force():
    r = random.Random(3)
    for _ in range(20):
        base = bytes(r.choice(b"ab") for _ in range(300))
        strings = list({base[r.randint(0, 40) : r.randint(200, 300)] + bytes([r.choice(b"xyz")]) for _ in range(8)})
        index = op.RunIndex(strings)
        for k, s in enumerate(strings):
            ms = index.matching_statistics(int(index.starts[k]), len(s))
            for j in range(0, len(s) - 20, 7):
                here = s[j : j + 20]
                again = sum(t[i : i + 20] == here for t in strings for i in range(len(t) - 19))
                assert (ms[j] >= 20) == (again > 1)


def test_query_digest(spark, tmp_path):
    texts = ["q" * 10 + "w" * 5, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op.op4_runindex(spark, str(tmp_path)).collect()}
    assert rows[0].kept_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    assert tuple(rows[1])[:4] == (1, 0, 0, 0)


def test_index_where_following_strings_are_alike():
    r = random.Random(8)
    missed = 0
    for _ in range(40):
        pool = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(80, 180))) for _ in range(4)]
        strings = []
        for _ in range(24):  # tails alike, and after them strings alike: together over 512 bytes
            s = b"".join(r.choice(pool) for _ in range(2))
            strings.append(s + bytes([r.choice(b"xyz")]) * r.randint(0, 1))
        strings = [s for s in strings if len(s) >= 200]
        index = op.RunIndex(strings)
        of, first, last = index.hits(np.arange(len(strings)), 200)
        have = {(k, i) for k, s, e in zip(of.tolist(), first.tolist(), last.tolist()) for i in range(s, e - 199)}
        seen = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1}
        missed += have != want
        for k, s in enumerate(strings):
            ms = index.matching_statistics(int(index.starts[k]), len(s) - 199)
            assert {i for i in range(len(s) - 199) if ms[i] >= 200} == {i for j, i in want if j == k}
    assert not missed
