import random

import duckdb
import pytest

from tracewright.llm import op02_snapshots as op

SCHEMA = "conv_id long, turn long, role string, text string, pos int, n string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v)
    convs = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda t: tuple(map(low, t)))) for c, v in convs.items()}
    return {c: v for c, v in convs.items() if not any((w[: len(v)] == v and len(w) > len(v)) or (w == v and d < c) for d, w in convs.items())}


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3), (3, 1)])
def test_maximal_conversations(spark, monkeypatch, seed, block):
    monkeypatch.setattr(op, "BLOCK", block)
    r = random.Random(seed)
    rows = [(None, 1, "user", "x")]
    logs = [[(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "é" * 50])) for _ in range(r.randint(1, 9))] for _ in range(12)]
    for c in range(60):
        log = r.choice(logs)
        cut = log[: r.randint(1, len(log))]
        rows += [(c, i, *t) for i, t in enumerate(cut)]
    rows += [(99, 5, "user", "tie"), (99, 5, "user", "tie"), (99, None, "user", "first"), (98, 4, "user", "first"), (98, 4, "user", "tie")]
    got = {}
    for x in op.collapse(spark.createDataFrame([(*y, 7, "n") for y in rows], SCHEMA)).orderBy("conv_id", "pos").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert {c: tuple(v) for c, v in got.items()} == brute(rows)


def test_render_and_query(spark, tmp_path):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 1, "user", "hi"), (3, 1, None, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = sorted(map(tuple, op.op2_snapshots(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(op.SQL).fetchall()) and [g[0] for g in got] == [1, 3]
    whole = {r.conv_id: r.rendered for r in op.render_whole(op.collapse(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()}
    assert whole[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_empty_table(spark):
    assert op.collapse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_is_no_text(spark):
    rows = [(1, 1, "user", None), (2, 1, "user", "\0"), (3, 1, "user", ""), (4, 1, None, ""), (5, 1, "\0", "")]
    got = op.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3, 4, 5]
