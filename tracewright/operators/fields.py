"""Which part of a rendering a message field made: found by rendering without the field and comparing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import char_offsets
from . import chat, textmatch
from .traces import ROLE_SOURCE, TraceSet

FIELDS = {"reasoning": "reasoning", "tool_calls": "tool_call"}
ANCHOR = 32


def difference(full: str, without: str) -> tuple[int, int] | None:
    """The span of ``full`` between the common beginning and the common end; None if nothing was taken out."""
    if len(full) <= len(without):
        return None
    p = 0
    while p < len(without) and full[p] == without[p]:
        p += 1
    q = 0
    while q < len(without) - p and full[-1 - q] == without[-1 - q]:
        q += 1
    return p, len(full) - q


def differences(full: str, without: str, anchor: int = ANCHOR) -> list[tuple[int, int]]:
    """All spans of ``full`` that ``without`` lacks, in order: after each the texts meet again at the next ``anchor`` characters."""
    out, i, j = [], 0, 0
    while i < len(full):
        while i < len(full) and j < len(without) and full[i] == without[j]:
            i, j = i + 1, j + 1
        if i >= len(full):
            break
        rest = without[j : j + anchor]
        at = full.find(rest, i) if rest else len(full)
        if at < 0:
            return out + [(i, len(full))]
        if at > i:
            out.append((i, at))
        else:
            break
        i = at
    return out


def field_chunks(messages: list[dict], render: Callable[[list[dict]], str], field: str) -> list[tuple[int, int, int]]:
    """(message, start, end) of what the field of each message made in the rendering."""
    having = [k for k, m in enumerate(messages) if m.get(field)]
    if not having:
        return []
    strip = lambda keep: [m if k not in keep else {a: b for a, b in m.items() if a != field} for k, m in enumerate(messages)]
    full = render(messages)
    spans = differences(full, render(strip(set(having))))
    if len(spans) == len(having):
        return [(k, *s) for k, s in zip(having, spans)]
    one = ((k, difference(full, render(strip({k})))) for k in having)
    return [(k, *s) for k, s in one if s]


def plain_template(messages: list[dict]) -> str:
    """The template of ``chat.render`` with fields: reasoning in <think>, tool calls as a block."""
    out = chat.BEGIN
    for m in messages:
        think = f"<think>{m['reasoning']}</think>" if m.get("reasoning") else ""
        calls = "".join(f"<call>{c.get('name')}({json.dumps(c.get('arguments'), ensure_ascii=False)})</call>" for c in m.get("tool_calls") or [])
        out += f"[{m['role']}]{think}{m.get('content') or ''}{calls}{chat.TERMINATOR}"
    return out


def render_fields(messages: DataFrame, template: Callable[[list[dict]], str] = plain_template) -> tuple[DataFrame, DataFrame]:
    """Renderings (sample_id, text), and chunks (sample_id, tag, role, s_start, s_end) of messages with reasoning and tool_calls (JSON)."""
    packed = messages.groupBy("sample_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "reasoning", "tool_calls")))).alias("ms"))

    def parse(text: str) -> list[dict]:
        return [{**m, "tool_calls": json.loads(m["tool_calls"]) if m.get("tool_calls") else None} for m in json.loads(text)]

    def rendered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"sample_id": f["sample_id"], "text": [template(parse(x)) for x in f["ms"]]})

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for sid, x in zip(f["sample_id"], f["ms"]):
                ms = parse(x)
                rows += [(sid, tag, ms[k]["role"], a, b) for field, tag in FIELDS.items() for k, a, b in field_chunks(ms, template, field)]
            yield pd.DataFrame(rows, columns=["sample_id", "tag", "role", "s_start", "s_end"])

    return packed.mapInPandas(rendered, "sample_id string, text string"), packed.mapInPandas(chunks, "sample_id string, tag string, role string, s_start long, s_end long")


def tag_fields(ts: TraceSet, messages: DataFrame, template: Callable[[list[dict]], str] = plain_template) -> TraceSet:
    """Annotate ``reasoning`` and ``tool_call`` tokens, and give them to their message's role.

    Samples whose tokens don't join to the rendering are left alone; references only partly inside are expanded.
    """
    text, chunks = render_fields(messages, template)
    flat = ts.expanded_tokens()
    good = text.join(textmatch.joined_text(flat).withColumnRenamed("text", "joined"), "sample_id").where("text = joined").select("sample_id")
    placed = char_offsets(flat.join(good, "sample_id", "left_semi").select("sample_id", "pos", "token"), ["sample_id"])
    hit = placed.join(chunks, "sample_id").where("c_end > s_start AND c_start < s_end").select("sample_id", "pos", "tag", "role").distinct()
    sig = hit.groupBy("sample_id", "pos").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "tag", "role"))), ",").alias("sig"))
    out = ts.materialize_inconsistent(sig)
    native = out.expanded_tokens().select("sample_id", "pos", F.col("from_pos").alias("native")).join(hit, ["sample_id", "pos"]).select("sample_id", F.col("native").alias("pos"), "tag", "role").distinct()
    out = out.annotate_positions(native.select("sample_id", F.col("tag").alias("name"), "pos"), '{"source":"template_field"}')
    for r in [x.role for x in chunks.select("role").distinct().collect()]:  # a handful of role names
        out = chat.move_to_role(out, r, native.where(F.col("role") == r).select("sample_id", "pos"))
    return out


__all__ = ["FIELDS", "ROLE_SOURCE", "difference", "differences", "field_chunks", "render_fields", "tag_fields"]
