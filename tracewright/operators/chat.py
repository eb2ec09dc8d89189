"""Chat messages: rendering, names, token ranges, roles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists as L
from . import textmatch
from .traces import ROLE_SOURCE, TraceSet

#: A plain template: begin mark, then [role] content [end] for every message.
BEGIN, TERMINATOR = "<s>", "[end]"


def render(messages: DataFrame, order: bool = False) -> DataFrame:
    """(sample_id, text) of messages (sample_id, turn, role, content) in turn order; a null content is empty. With ``order`` also the least sample_ord."""
    part = F.concat(F.lit("["), "role", F.lit("]"), F.coalesce("content", F.lit("")), F.lit(TERMINATOR))
    least = [F.min("sample_ord").alias("sample_ord")] if order else []
    rows = messages.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("t"), *least)
    return rows.select("sample_id", F.concat(F.lit(BEGIN), F.array_join("t.part", "")).alias("text"), *["sample_ord"] * order)


def name_messages(messages: DataFrame) -> DataFrame:
    """``messages`` with name: the role and its count so far in the sample, from 0."""
    w = Window.partitionBy("sample_id", "role").orderBy("turn")
    return messages.withColumn("name", F.concat_ws("_", "role", (F.row_number().over(w) - 1).cast("string")))


def message_char_ends(rendered: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """(sample_id, k, c_end): where the k-th terminator ends, from 0, in code points."""
    parts = F.split("text", F.concat(F.lit("\\Q"), F.lit(terminator), F.lit("\\E")), -1)
    ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) + len(terminator))
    rows = rendered.select("sample_id", F.posexplode(ends).alias("k", "len"))
    w = Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("sample_id", F.col("k").cast("long").alias("k"), F.sum("len").over(w).cast("long").alias("c_end"))


def _by_sample(messages: DataFrame, *columns: str) -> DataFrame:
    """(sample_id, ms): a sample's messages in turn order."""
    return messages.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("turn", *columns))).alias("ms"))


def message_ranges(messages: DataFrame, tokens: DataFrame, rendered: DataFrame, terminator: str = TERMINATOR, lists: L.Lists | None = None) -> DataFrame:
    """(sample_id, turn, role, name, start, end): the tokens split among the messages at the terminators.

    The first message starts at 0 and the last ends at the end, whatever stands there; a border inside a
    token gives that token to the message before. Samples whose terminators don't count like their messages,
    or whose tokens don't join to the rendering, have null ranges.
    """
    kind = messages.schema["turn"].dataType.simpleString()

    def each(batch: pa.RecordBatch, b: L.Batch) -> Iterator[tuple]:
        rows: list[list] = [[] for _ in range(6)]
        for r, (ms, text) in enumerate(zip(batch.column("ms").to_pylist(), batch.column("rendered").to_pylist())):
            m, seen, before = len(ms), {}, 0
            starts, ends = b.offsets(r)
            ok = text is not None and len(ends) > 0 and b.text(r) == text and text.count(terminator) == m
            at = 0
            for k, x in enumerate(ms):
                role = x["role"]
                seen[role] = seen.get(role, -1) + 1
                start = end = None
                if ok:
                    at = text.index(terminator, at) + len(terminator)
                    next_ = int(np.searchsorted(starts, at, "left"))
                    end = len(ends) if k == m - 1 or next_ == len(ends) else int(b.positions(r, np.array([next_]))[0])
                    start, before = before, end
                for column, v in zip(rows, (r, x["turn"], role, f"{seen[role]}" if role is None else f"{role}_{seen[role]}", start, end)):
                    column.append(v)
        yield batch.column("sample_id").take(pa.array(rows[0], pa.int64())), *rows[1:]

    lists = lists or L.Lists.of(tokens)
    j = lists.table((_by_sample(messages, "role"), "right"), (rendered.withColumnRenamed("text", "rendered"), "left"))
    return L.mapped(lists, j, each, f"sample_id string, turn {kind}, role string, name string, start long, end long")


def chat_traces(messages: DataFrame, tokens: Column | None = None, tokenizer: str | None = None) -> TraceSet:
    """One sample per conversation of messages (sample_ord, sample_id, turn, role, content): rendered, tokenized, with a text per message.

    Tokens are those of the ``tokenizer`` file, of the column expression, or else characters.
    """
    rendered = render(messages)
    texts = render(messages, order=True)
    if tokenizer:
        base = TraceSet.from_texts(texts, tokenizer=tokenizer)
    else:
        base = TraceSet.from_texts(texts, "chars" if tokens is None else tokens)
    r = message_ranges(messages.select("sample_id", "turn", "role", "content"), base.tokens, rendered, lists=base.listed)
    named = name_messages(messages).select("sample_id", "turn", F.coalesce("content", F.lit("")).alias("value"))
    w = Window.partitionBy("sample_id").orderBy("turn")
    texts = r.join(named, ["sample_id", "turn"]).select("sample_id", F.lpad((F.row_number().over(w) - 1).cast("string"), 8, "0").alias("path"), F.lit(None).cast("string").alias("parent"), "name", "value", "start", "end", F.lit("{}").alias("metadata"))
    return replace(base, texts=texts)


def role_runs(lists: L.Lists, messages: DataFrame, rendered: DataFrame, fallback: str = "template") -> DataFrame:
    """The annotations of ``tag_chat_roles`` where nothing has to be expanded: runs of tokens of one role, found inside the sample's row."""

    def each(batch: pa.RecordBatch, b: L.Batch) -> Iterator[tuple]:
        rows: list[list] = [[] for _ in range(5)]
        for r, (ms, text) in enumerate(zip(batch.column("ms").to_pylist(), batch.column("rendered").to_pylist())):
            starts, ends = b.offsets(r)
            if not len(ends) or b.text(r) != text:
                continue
            spans = textmatch.seek([(m["role"], m["content"]) for m in ms], text)
            names = sorted({fallback, *(s[0] for s in spans if s[0] is not None)})
            roles = np.full(len(ends), names.index(fallback))
            for role, s, e in reversed(spans):  # of spans that hold a token the first counts
                first, last = L.held(starts, ends, s, e)
                roles[first:last] = names.index(fallback if role is None else role)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(roles)) + 1, [len(roles)]])
            order = {k: i for i, k in enumerate(sorted({*roles.tolist()}))}
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                k = int(roles[s])
                for column, v in zip(rows, (r, order[k], names[k], s, e)):
                    column.append(v)
        yield batch.column("sample_id").take(pa.array(rows[0], pa.int64())), *rows[1:]

    j = lists.table((_by_sample(messages, "role", "content"), "inner"), (rendered.withColumnRenamed("text", "rendered"), "inner"))
    found = L.mapped(lists, j, each, "sample_id string, ann_ord long, name string, start long, end long")
    return found.withColumn("metadata", F.lit(ROLE_SOURCE))


def tag_chat_roles(ts: TraceSet, messages: DataFrame, rendered: DataFrame | None = None) -> TraceSet:
    """Annotate every token with the role of the message that holds it whole, else ``template``.

    Samples whose expanded tokens don't join to the rendering are left alone. References that
    span several roles are expanded first; annotations carry the source message_role.
    """
    rendered = render(messages) if rendered is None else rendered
    if ts.listed and ts.no_annotations and not ts.listed.sequences:
        found = role_runs(ts.listed, messages, rendered)
        return replace(ts, annotations=found, no_annotations=False, merged=found)
    flat = ts.expanded_tokens()
    joined = textmatch.joined_text(flat).withColumnRenamed("text", "joined")
    good = rendered.join(joined, "sample_id").where("text = joined").select("sample_id", "text")
    spans = textmatch.message_spans(messages, good)
    roles = textmatch.containing_role(flat.join(good, "sample_id", "left_semi"), spans)
    out = ts.materialize_inconsistent(roles.select("sample_id", "pos", F.col("role").alias("sig")))
    inside = out.expanded_tokens().select("sample_id", "pos", "from_pos").join(roles.hint("merge"), ["sample_id", "pos"])
    return out.annotate_positions(inside.select("sample_id", F.col("role").alias("name"), F.col("from_pos").alias("pos")), ROLE_SOURCE)


def move_to_role(ts: TraceSet, role: str, positions: DataFrame) -> TraceSet:
    """Take positions (sample_id, pos) from all other role annotations and give them to ``role``."""
    from ..functions.ranges import positions_to_ranges, ranges_to_positions

    others = ts.annotations.where((F.col("metadata") == ROLE_SOURCE) & (F.col("name") != role))
    left = ranges_to_positions(others, ["sample_id", "ann_ord", "name", "metadata"]).join(positions, ["sample_id", "pos"], "left_anti")
    again = positions_to_ranges(left, ["sample_id", "ann_ord", "name", "metadata"]).select(*ts.annotations.columns)
    rest = ts.annotations.where((F.col("metadata") != ROLE_SOURCE) | (F.col("name") == role))
    return replace(ts, annotations=rest.unionByName(again)).annotate_positions(positions.withColumn("name", F.lit(role)), ROLE_SOURCE)


def message_token_range(tokens: DataFrame, rendered: DataFrame, needle: DataFrame, last: bool = True, lists: L.Lists | None = None) -> DataFrame:
    """(sample_id, start, end): tokens overlapping the last (or first) occurrence of needle (sample_id, content) in the rendering."""

    def each(batch: pa.RecordBatch, b: L.Batch) -> Iterator[tuple]:
        rows: list[list] = [[] for _ in range(3)]
        for r, (text, content) in enumerate(zip(batch.column("rendered").to_pylist(), batch.column("content").to_pylist())):
            if b.bounds[r] == b.bounds[r + 1] or b.text(r) != text:
                continue
            at = text.rfind(content) if last else text.find(content)
            if at >= 0:
                first, end = L.overlapped(*b.offsets(r), at, at + len(content))
                if first < end:
                    here = b.positions(r, np.array([first, end - 1]))
                    for column, v in zip(rows, (r, int(here[0]), int(here[1]) + 1)):
                        column.append(v)
        yield batch.column("sample_id").take(pa.array(rows[0], pa.int64())), *rows[1:]

    lists = lists or L.Lists.of(tokens)
    j = lists.table((rendered.withColumnRenamed("text", "rendered"), "inner"), (needle.where("coalesce(content, '') <> ''"), "inner"))
    return L.mapped(lists, j, each, "sample_id string, start long, end long")


def last_reply(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """(sample_id, content) of each sample's last message of the role with content."""
    m = messages.where((F.col("role") == role) & (F.coalesce("content", F.lit("")) != ""))
    return m.groupBy("sample_id").agg(F.max_by("content", "turn").alias("content"))


def tag_generated(ts: TraceSet, messages: DataFrame, rendered: DataFrame | None = None) -> TraceSet:
    """Annotate ``generated``: the last assistant message with content, in the rendering of the messages or the one given."""
    lists = ts.listed if ts.listed and not ts.listed.sequences else None
    r = message_token_range(ts.expanded_tokens(), render(messages) if rendered is None else rendered, last_reply(messages), lists=lists)
    return ts.annotate(r.withColumn("name", F.lit("generated")), '{"source":"converter"}')
