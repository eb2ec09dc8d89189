import itertools
import random
import re

import numpy as np
import pytest

from tracewright.llm import op05_minhash as op


def brute(rows, k=2, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and i * 100 >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["W%d" % i for i in range(400)] + ["é", "É", "a b"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One\ttwo"), (7, "one two three")]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 12, 60, 200]))] for _ in range(8)]
    for d in range(10, 170):
        w = list(r.choice(bases))
        for _ in range(int(len(w) * r.choice([0, 0.02, 0.04, 0.06, 0.1]))):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,k,docs", [(1, 2, 256), (2, 2, 7), (3, 5, 20)])
def test_matches_brute_force(spark, monkeypatch, seed, k, docs):
    monkeypatch.setattr(op, "BLOCK_DOCS", docs)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "s", 5) for x in rows], "doc_id long, text string, rep int, sig string, component_id int")
    got = {r.doc_id: tuple(r)[1:] for r in op.near_duplicates(df, shingle=k).collect()}
    assert got == brute(rows, k)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (2, "a b c"), (9, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("9", 9, True), ("None", None, True)]


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_bound():
    assert all(op.least_matches(n, 0.8, 1e-9) <= 0.8 * n for n in (40, 80, 200))
    assert op.least_matches(200, 0.8, 1e-9) > 100
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (op.signature(a) == op.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.12


def test_ids_of_several_texts(spark):
    words = lambda x: [f"{x}{i}" for i in range(120)]
    a, b = words("a"), words("b")
    rows = [("5", " ".join(a)), ("5", " ".join(b)), ("8", " ".join([*a[:-1], "x"])), ("9", " ".join([*b[:-1], "y"])), ("7", " ".join(words("c")))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("8", "5", False), ("9", "5", False)]


def test_no_ids_go_through_the_driver(spark, monkeypatch):
    """The ids of candidates are neither broadcast nor collected; a filter that lets nearly all rows through changes nothing."""

    def refuse(df):
        raise AssertionError("broadcast")

    monkeypatch.setattr(op.F, "broadcast", refuse)
    monkeypatch.setattr(op, "MIN_BITS", 64, raising=False)
    monkeypatch.setattr(op, "MAX_BITS", 64, raising=False)
    rows = corpus(6)
    got = {r.doc_id: tuple(r)[1:] for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_sieve_keeps_members(spark):
    rows = spark.range(30_000).selectExpr("concat('d', id) AS name", "id")
    bits = op.sieve(rows.where("id % 10 = 0"), "name")
    kept = {r.id for r in op.sift(rows, "name", bits, ["id"]).collect()}
    assert set(range(0, 30_000, 10)) <= kept and len(kept) < 5_000 and bits.nbytes == 8192


def test_disk_is_freed_as_soon_as_possible(spark, monkeypatch):
    import os

    there, save = {}, op.Scratch.save

    def watched(self, df, name, free=False):
        there[name] = (free, {n for n in there if os.path.exists(self.path(n).removeprefix("file:"))})
        return save(self, df, name, free)

    monkeypatch.setattr(op.Scratch, "save", watched)
    texts = [" ".join(f"w{(d // 3) * 1000 + i}" for i in range(60)) + " x" * (d % 3) for d in range(30)]
    got = op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 3 * 3 for d in range(30)}
    assert all(there[n][0] for n in ("classes", "reps", "bands", "sets", "judged", "marked", "links", "placed"))
    assert not {"bands", "stars", "sigs"} & there["open"][1] and not {"reps", "sets", "judged", "member"} & there["placed"][1]
