"""Regular expressions over the joined text of each sample."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions.tokens import char_offsets


#: Python's str.strip in Java's regular expressions.
STRIPPED = r"regexp_replace(x.content, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '')"


def joined_text(tokens: DataFrame) -> DataFrame:
    """(sample_id, text): each sample's tokens in order. A sample is one row here, as everywhere at the sources and sinks."""
    rows = tokens.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.select("sample_id", F.array_join("t.token", "").alias("text"))


def text_matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(sample_id, m, m_start, m_end): every non-empty match, in code points, by Python's engine."""
    compiled = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, k, m.start(), m.end()) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k, m in enumerate(x for x in compiled.finditer(t) if x.end() > x.start())]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["sample_id", "m", "m_start", "m_end"])

    return texts.select("sample_id", "text").mapInArrow(run, "sample_id string, m long, m_start long, m_end long")


def overlapping(tokens: DataFrame, pattern: str, mode: str = "all", lists: L.Lists | None = None) -> DataFrame:
    """(sample_id, pos) of the tokens that overlap a match: ``all``, or each match's ``first`` or ``last``; by Python's engine.

    Matches and tokens meet inside the sample's row, so every token is read once.
    """
    if mode not in ("all", "first", "last"):
        raise ValueError(f"mode {mode!r} is none of all, first, last")
    compiled = re.compile(pattern)

    def each(batch: pa.RecordBatch, b: L.Batch) -> Iterator[tuple]:
        for r in range(len(b.names)):
            text, found, offsets = b.text(r), [], None
            for m in compiled.finditer(text):
                if m.end() > m.start():
                    offsets = offsets or b.offsets(r)
                    first, last = L.overlapped(*offsets, m.start(), m.end())
                    if first < last:
                        found.append(np.arange(first, last) if mode == "all" else [first if mode == "first" else last - 1])
            if found:
                at = np.unique(np.concatenate(found))
                yield b.names.take(pa.array(np.full(len(at), r))), b.positions(r, at)

    lists = lists or L.Lists.of(tokens)
    return L.mapped(lists, lists.table(), each, "sample_id string, pos long")


def containing_role(tokens: DataFrame, spans: DataFrame, fallback: str = "template") -> DataFrame:
    """(sample_id, pos, role): the role of the first span (sample_id, span_ord, role, s_start, s_end) that holds the whole token."""
    placed = char_offsets(tokens.select("sample_id", "pos", "token"), ["sample_id"])
    inside = placed.join(spans, "sample_id").where("c_start >= s_start AND c_end <= s_end")
    first = inside.groupBy("sample_id", "pos").agg(F.min_by("role", "span_ord").alias("role"))
    return placed.select("sample_id", "pos").join(first, ["sample_id", "pos"], "left").select("sample_id", "pos", F.coalesce("role", F.lit(fallback)).alias("role"))


def seek(messages: list[tuple[str, str]], text: str) -> list[tuple[str, int, int]]:
    """(role, begin, end) of messages (role, content) sought one after the other, each from where the last find ended, else stripped."""
    out, at = [], 0
    for role, content in messages:
        for form in (content, content and content.strip()):
            if form and (s := text.find(form, at)) >= 0:
                at = s + len(form)
                out.append((role, s, at))
                break
    return out


def message_spans(messages: DataFrame, text: DataFrame) -> DataFrame:
    """(sample_id, span_ord, role, s_start, s_end): messages (sample_id, turn, role, content) sought one after the other.

    A fold over each sample's messages: the search starts where the last find ended; what isn't found as it is
    is sought stripped, and else passed over.
    """
    m = messages.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("ms"))
    j = m.join(text, "sample_id")
    found = F.expr(
        """aggregate(ms, struct(0L AS cur, cast(array() AS array<struct<role:string,s:bigint,e:bigint>>) AS out), (a, x) ->
        CASE WHEN coalesce(x.content, '') = '' THEN a
        WHEN locate(x.content, text, cast(a.cur + 1 AS int)) > 0 THEN struct(locate(x.content, text, cast(a.cur + 1 AS int)) - 1 + cast(length(x.content) AS bigint) AS cur,
            array_append(a.out, struct(x.role AS role, cast(locate(x.content, text, cast(a.cur + 1 AS int)) - 1 AS bigint) AS s, locate(x.content, text, cast(a.cur + 1 AS int)) - 1 + cast(length(x.content) AS bigint) AS e)) AS out)
        WHEN strip(x.content) <> '' AND locate(strip(x.content), text, cast(a.cur + 1 AS int)) > 0 THEN struct(locate(strip(x.content), text, cast(a.cur + 1 AS int)) - 1 + cast(length(strip(x.content)) AS bigint) AS cur,
            array_append(a.out, struct(x.role AS role, cast(locate(strip(x.content), text, cast(a.cur + 1 AS int)) - 1 AS bigint) AS s, locate(strip(x.content), text, cast(a.cur + 1 AS int)) - 1 + cast(length(strip(x.content)) AS bigint) AS e)) AS out)
        ELSE a END, a -> a.out)""".replace("strip(x.content)", STRIPPED)
    )
    return j.select("sample_id", F.posexplode(found).alias("span_ord", "x")).select("sample_id", F.col("span_ord").cast("long").alias("span_ord"), "x.role", F.col("x.s").alias("s_start"), F.col("x.e").alias("s_end"))


def latest_before(tokens: DataFrame, marks: DataFrame) -> DataFrame:
    """(sample_id, mark, pos): the first token that starts at or after each character mark (sample_id, mark)."""
    placed = char_offsets(tokens.select("sample_id", "pos", "token"), ["sample_id"])
    rows = placed.select("sample_id", F.col("c_start").alias("at"), "pos", F.lit(0).alias("is_mark")).unionByName(marks.select("sample_id", F.col("mark").alias("at"), F.lit(None).cast("long").alias("pos"), F.lit(1).alias("is_mark")))
    w = Window.partitionBy("sample_id").orderBy(F.desc("at"), F.asc("is_mark"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("next", F.min("pos").over(w)).where("is_mark = 1").select("sample_id", F.col("at").alias("mark"), F.col("next").alias("pos"))
