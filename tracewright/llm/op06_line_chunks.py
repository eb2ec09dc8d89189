"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of three consecutive lines ends a chunk where it is divisible
by ``DIVISOR``, so boundaries follow the content and a block of lines is cut alike wherever
it stands. A chunk of two lines or more that stands anywhere earlier in the table is removed:
hashes find the repeats, then the bytes are compared with those of the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

DIVISOR = 4
#: Tables of (document, chunks) are broadcast up to this many documents and chunks together, which is below 20 MB.
MAX_BROADCAST = 200_000

_HASH = "cast(conv(substr(md5(x), 1, 8), 16, 10) AS bigint)"
#: One-element transforms name what is used again: a column of its own would be computed again wherever a filter is pushed past it.
_CHUNKS = f"""transform(array(split(coalesce(T, ''), '\n', -1)), lines -> transform(array(transform(lines, x -> {_HASH})), hashes ->
    transform(array(filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 OR
        (31 * get(hashes, i) + 17 * coalesce(get(hashes, i - 1), 0L) + 7 * coalesce(get(hashes, i - 2), 0L)) % {DIVISOR} = 0)), ends ->
    transform(ends, (e, k) -> slice(lines, coalesce(get(ends, k - 1), -1) + 2, e - coalesce(get(ends, k - 1), -1))))[0])[0])[0]"""


def _chunks(column: str) -> Column:
    """The text as its list of line lists."""
    return F.expr(_CHUNKS.replace("T,", f"`{column}`,"))


def _key() -> Column:
    text = F.col("text").cast("string")
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text), F.xxhash64(F.lit(2), text))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, t): the key is the doc_id and a hash of the text, so null and repeated ids do no harm."""
    return docs.select(_key().alias("key"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t"))


def _chunked(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("chunks", _chunks("t"))


def _small(df: DataFrame, listed: str) -> DataFrame:
    """Broadcast if its counted rows and the elements of their lists are few enough; else joined by shuffle."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(1 + F.size(listed)), F.lit(0))).first()[0] <= MAX_BROADCAST else df


def _left(chunks: str, gone: str) -> Column:
    """The lines of the chunks that stay, in time linear in the chunks."""
    return F.array_join(F.flatten(F.expr(f"transform(array_except(sequence(0, size({chunks}) - 1), {gone}), k -> get({chunks}, k))")), "\n")


def repeated_chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, gone) of the texts that lose chunks; gone lists the chunks' numbers."""
    chunked = _chunked(_keyed(docs)).select("key", "id", F.posexplode_outer("chunks").alias("k", "chunk")).where("size(chunk) > 1")
    hashed = scratch.save(chunked.select("key", "id", "k", F.xxhash64(F.array_join("chunk", "\n")).alias("h")), "hashed")
    again = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "k")).alias("first")).where("n > 1")
    again = scratch.save(again.select("h", "first.key", "first.k").withColumnsRenamed({"key": "first_key", "k": "first_k"}), "again")
    at = hashed.join(again.select("h"), "h", "left_semi").groupBy("key").agg(F.collect_set(F.struct("k", "h")).alias("at"))
    at = scratch.save(at, "at")
    texts = _keyed(docs).select("key", "t").join(_small(at, "at"), "key").dropDuplicates(["key"])
    rows = _chunked(texts).select("key", "chunks", F.explode_outer("at").alias("x")).select("key", "x.k", "x.h", F.array_join(F.expr("chunks[x.k]"), "\n").alias("bytes"))
    rows = scratch.save(rows, "bytes")
    first = rows.join(again, "h").where("key = first_key AND k = first_k").select("h", F.col("bytes").alias("first_bytes"), "first_key", "first_k")
    gone = rows.join(first, "h").where("bytes = first_bytes AND NOT (key = first_key AND k = first_k)")
    gone = scratch.save(gone.groupBy("key").agg(F.collect_set("k").alias("gone")), "gone")
    scratch.drop("hashed", "again", "at", "bytes")
    return gone


def cut_lines(docs: DataFrame) -> DataFrame:
    """(id, t, n_lines, n_removed_lines, n_removed_chunks, kept) of every row of ``docs`` (doc_id, text, ...).

    The first occurrence of a chunk (smallest doc_id, nulls first, then place) stays. A null
    text stays null and has no lines; an empty text is one empty line. Rows that repeat both
    doc_id and text count as one text and are cut alike. Other columns are unused, whatever
    their names; an empty table gives an empty result. ``kept`` is the remaining lines.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_chunks(docs, scratch)
    joined = _chunked(_keyed(docs).join(_small(gone, "gone"), "key", "left"))
    removed = F.expr("aggregate(gone, 0L, (a, k) -> a + size(chunks[k]))")
    none = F.col("gone").isNull()
    return joined.select(
        "id", "t",
        F.when(F.col("t").isNull(), 0).otherwise(F.expr("aggregate(chunks, 0L, (a, c) -> a + size(c))")).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(removed).cast("long").alias("n_removed_lines"),
        F.when(none, F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed_chunks"),
        F.when(none, F.col("t")).otherwise(_left("chunks", "gone")).alias("kept"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text`` (and n_chars, if present, counted again); same columns and rows.

    Null, empty and repeated texts, ties and an empty table are as in ``cut_lines``. Columns may have any names but those that begin with ``__``.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = _small(repeated_chunks(docs, scratch), "gone").select(F.col("key").alias("__lines_key"), F.col("gone").alias("__lines_gone"))
    key = _key()
    joined = docs.withColumn("__key", key).join(gone, F.col("__key") == F.col("__lines_key"), "left").withColumn("__chunks", F.when(F.col("__lines_gone").isNotNull(), _chunks("text")))
    kept = _left("__chunks", "__lines_gone")
    text = F.when(F.col("__lines_gone").isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns)


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def removal_sql(source: str) -> str:
    """DuckDB: CTEs up to ``chunk`` (doc_id, k, n, body, gone) over a table with unique doc_ids."""
    return f"""
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source} WHERE text IS NOT NULL),
hashed AS (SELECT *, CAST('0x' || md5(x)[1:8] AS BIGINT) AS h FROM line),
rolled AS (SELECT *, (31 * h + 17 * coalesce(lag(h) OVER w, 0) + 7 * coalesce(lag(h, 2) OVER w, 0)) % {DIVISOR} = 0 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rolled),
chunk0 AS (SELECT doc_id, k, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k),
chunk AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, body ORDER BY doc_id, k) > 1 AS gone FROM chunk0)"""


SQL = f"""
WITH {removal_sql("documents")}
SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_lines, count(*) FILTER (gone) AS n_removed_chunks,
    CASE WHEN any_value(d.text) IS NOT NULL THEN md5(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) END AS kept_md5
FROM documents d LEFT JOIN chunk USING (doc_id) GROUP BY d.doc_id"""
