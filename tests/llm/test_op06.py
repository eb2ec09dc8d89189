import random
from collections import Counter

import duckdb
import pytest

from tracewright.llm import op06_line_chunks as op

SCHEMA = "doc_id long, text string, key string, gone int, n_chars long"


def corpus(seed):
    r = random.Random(seed)
    lines = [f"line {i} é" for i in range(40)] + ["", " ", "x"]
    block = [r.choice(lines) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "only"), (4, "a\nb\n")]
    for d in range(10, 60):
        body = [r.choice(lines) for _ in range(r.randint(0, 20))]
        if r.random() < 0.6:
            at = r.randrange(len(body) + 1)
            body[at:at] = block[r.randint(0, 5) : r.randint(15, 25)]
        rows.append((d, "\n".join(body)))
    return [(*x, "k", 1, len(x[1] or "")) for x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sql_and_table_form(spark, seed):
    rows = corpus(seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.n_lines, r.n_removed_lines, r.n_removed_chunks, r.kept) for r in op.cut_lines(docs).collect()}
    import hashlib

    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    want = {r[0]: r[1:] for r in con.execute(op.SQL).fetchall()}
    assert {d: (*x[:3], md5(x[3])) for d, x in got.items()} == want
    assert sum(x[2] for x in got.values()) > 10
    table = op.dedup_lines(docs)
    assert table.columns == docs.columns
    assert {r.doc_id: (r.text, r.key, r.gone) for r in table.collect()} == {d: (x[3], "k", 1) for d, x in got.items()}


def test_repeated_rows_and_null_ids(spark):
    block = "\n".join(f"same {i}" for i in range(30))
    rows = [(None, block), (7, block), (7, block), (7, block + "\nmore"), (3, None), (3, None)]
    got = op.cut_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter((r.id, r.n_removed_chunks > 0) for r in got)
    assert kept == {(None, False): 1, (7, True): 3, (3, False): 2}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.cut_lines(docs).collect() == [] and op.dedup_lines(docs).collect() == []
