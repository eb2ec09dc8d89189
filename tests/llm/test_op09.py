import duckdb
import pytest

from tracewright.llm import op09_cascade as op

TEXTS = [
    None, "", "  \n", "one two", "a b c d e f g h i j", "w1 w2 w3 w4 w5 w6 " * 4, "x\ny\nx\n\n x\nx\r\n" + "pad " * 12, "é ß # * $ % & | < > " * 5, " ".join(f"w{i}" for i in range(300)),
    "a a a a a a a", "a b c d e a b c d e z y x", "12 34 56 78 90 11 22 33 44 55 66", "ünïcödé 日本   x y\x0b1\x0c2\x1c3 " * 4,
]
SCHEMA = "doc_id long, text string, n_words string, kept int"


@pytest.fixture
def rows():
    return [(i if i else None, t, "c", 1) for i, t in enumerate(TEXTS + [" ".join(f"w{i % 40}" for i in range(20_000))] + TEXTS[4:6])]


def test_matches_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(map(str, con.execute(op.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in op.score_quality(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_filter_agrees_and_keeps_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = op.keep_quality(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in op.score_quality(docs).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_order_changes_no_verdict(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    a = op._prepared(docs).select("doc_id", op.verdict(op.BASE + op.RULES).alias("v")).collect()
    b = op._prepared(docs).select("doc_id", op.verdict((op.BASE + op.RULES)[::-1]).alias("v")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.score_quality(docs).collect() == [] and op.keep_quality(docs).collect() == []
