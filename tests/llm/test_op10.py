import duckdb

from pyspark.sql import functions as F

from tracewright.llm import op10_licenses as op

ROWS = [
    (1, "Released under the MIT License.", "a/b/1"), (2, "body words only here " * 20, "a/b/2"), (3, "body", "a/c/3"), (4, "Licensed under the Apache License, Version 2.0.", "a/4"),
    (5, "x y z " * 9 + "\nAll rights reserved.\nmore", "a/b/5"), (6, None, "a/b/deep/er/6"), (7, "", "z/7"), (8, "nothing", None), (9, "LICENSED UNDER the apache license version 2.0\n" + "w " * 5, "a/9"),
    (10, "the the of rights", "q/10"), (None, "Licensed under CC BY-NC 4.0.", "top"), (11, "x", "other"), (5, "x y z " * 9 + "\nAll rights reserved.\nmore", "a/b/5"),
]


def scan(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, path string, key string, score int")
    return {(r.doc_id, r.path): (r.license, r.how) for r in op.scan_licenses(docs, F.col("path")).collect()}, op.scan_licenses(docs, F.col("path")).count()


def test_headers_files_and_ancestors(spark):
    got, n = scan(spark, ROWS)
    assert n == len(ROWS)
    assert got[1, "a/b/1"] == ("MIT", "file") and got[2, "a/b/2"] == ("MIT", "inherited")
    assert got[3, "a/c/3"] == ("Apache-2.0", "inherited") and got[5, "a/b/5"] == ("proprietary", "header")
    assert got[6, "a/b/deep/er/6"] == ("MIT", "inherited") and got[7, "z/7"] == ("CC-BY-NC-4.0", "inherited")
    assert got[None, "top"][1] == "file" and got[8, None] == (None, "none")


def test_empty_table(spark):
    assert scan(spark, []) == ({}, 0)


def test_matches_sql(spark, tmp_path):
    rows = [(i, t, "s%d" % (i % 3), ["en", "fr"][i % 2]) for i, (_, t, _) in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(str, op.op10_licenses(spark, str(tmp_path)).collect())) and sorted(map(tuple, op.op10_licenses(spark, str(tmp_path)).collect())) == sorted(con.execute(op.SQL).fetchall())


def test_filter_is_exact():
    idf = {w: op._idf(1000, 900 if w in ("the", "of", "and", "to") else 3) for w in op.VOCABULARY}
    needles = op._needles(idf)
    for _, text in op.TEMPLATES:
        terms = op._terms(text)
        rest = sum((f * idf[w]) ** 2 for w, f in terms.items() if w not in needles)
        assert rest < op.THRESHOLD**2 * sum((f * idf[w]) ** 2 for w, f in terms.items())


def test_whole_licence_files(spark):
    from tracewright.llm import license_texts as lt

    mit = "MIT License\n\nCopyright (c) 2019 A. Person\n\n" + "\n\n".join([lt._MIT_GRANT, lt._MIT_NOTICE, lt._MIT_WARRANTY])
    bsd = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + "\n\n".join([lt._BSD_GRANT, "1. " + lt._BSD_1, "2. " + lt._BSD_2, "3. " + lt._BSD_3, lt._BSD_WARRANTY])
    header = "\n".join("# " + line for line in (lt._APACHE_1 + "\n" + lt._APACHE_2).split("\n")) + "\n\n" + "def f(x): return x\n" * 80
    gpl = "/*\n" + "\n".join(" * " + " ".join(p.split()) for p in lt._gpl("GNU General Public License", "version 3")) + "\n */\n\n" + "int main() { return 0; }\n" * 80
    apache = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n" + "terms of all kinds\n" * 50
    rows = [(1, mit, "a/LICENSE"), (2, "x", "a/x.py"), (3, bsd, "b/LICENSE.txt"), (4, "x", "b/c/x.py"), (5, header, "a/y.py"), (6, gpl, "a/z.c"), (7, "# SPDX-License-Identifier: MIT\nx = 1\n" + "y = 2\n" * 30, "b/s.py"), (8, apache, "d/COPYING"), (9, "x", "d/x.py"), (10, "x", "e.py")]
    got, _ = scan(spark, rows)
    want = {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "file"), 4: ("BSD-3-Clause", "inherited"), 5: ("Apache-2.0", "header"), 6: ("GPL-3.0", "header"), 7: ("MIT", "header"), 8: ("Apache-2.0", "file"), 9: ("Apache-2.0", "inherited"), 10: (None, "none")}
    assert {d: x for (d, _), x in got.items()} == want


def test_very_long_text(spark):
    got, _ = scan(spark, [(1, "word " * 60_000 + "\nReleased under the MIT License.\n" + "line\n" * 30_000, "a/1"), (2, "", "a/2")])
    assert got == {(1, "a/1"): ("MIT", "header"), (2, "a/2"): (None, "none")}


def test_disk_is_freed_as_soon_as_possible(spark, monkeypatch):
    saved, save = {}, op.Scratch.save

    def watched(self, df, name, free=False):
        import os

        saved[name] = (free, sorted(n for n in saved if os.path.exists(self.path(n).removeprefix("file:"))))
        return save(self, df, name, free)

    monkeypatch.setattr(op.Scratch, "save", watched)
    assert scan(spark, ROWS)[1] == len(ROWS)
    assert all(saved[n][0] for n in ("units", "weighed", "found", "own"))
    assert saved["found"][1] == ["weighed"] and saved["own"][1] == ["found"]
