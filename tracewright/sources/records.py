"""Evaluation records and logs as message, score and sample rows.

Input is a DataFrame of JSON lines (one ``json`` column) or Python dicts; the projection of one record is a pure
function run in Arrow batches, since JSON text has to be written as Python writes it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import running_sum

PROVIDERS = frozenset("openai anthropic google mistral cohere deepseek groq fireworks together perplexity replicate ollama vllm hf huggingface vertex bedrock azureml mockllm".split())


def strip_provider(model: str) -> str:
    """Without a leading provider, if an owner/name pair remains."""
    head, _, tail = model.partition("/")
    return tail if head.lower() in PROVIDERS and "/" in tail else model


def same_model(a: str, b: str) -> bool:
    return strip_provider(a).lower() == strip_provider(b).lower()


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x)


def record_messages(record: dict[str, Any]) -> list[dict[str, Any]]:
    """Messages of an instance record: role, content, reasoning, tool_calls.

    A single turn has the raw input and the first output (if it says anything); several turns come by turn_idx,
    their tool calls written into the content as tags.
    """
    if record.get("interaction_type", "single_turn") == "single_turn" or not record.get("messages"):
        out = record.get("output") or {}
        content = next(iter(out.get("raw") or []), "") or ""
        reasoning = "".join(out.get("reasoning_trace") or [])
        found = [{"role": "user", "content": _text((record.get("input") or {}).get("raw"))}]
        if content or reasoning:
            found.append({"role": "assistant", "content": content, **({"reasoning": reasoning} if reasoning else {})})
        return found
    found = []
    for m in sorted(record["messages"], key=lambda m: m.get("turn_idx") or 0):
        content = m.get("content") or ""
        for call in m.get("tool_calls") or []:
            tag = f"<tool_call name={call.get('name')} args={json.dumps(call.get('arguments'))}/>"
            content = f"{content}\n{tag}" if content else tag
        reasoning = m.get("reasoning_trace")
        reasoning = "".join(reasoning) if isinstance(reasoning, list) else reasoning
        found.append({"role": m.get("role"), "content": content, **({"reasoning": reasoning} if reasoning else {})})
    return found


def record_score(record: dict[str, Any]) -> dict[str, Any] | None:
    """The record's one score; the answer is that of the first terminal attribution."""
    e = record.get("evaluation")
    if not e:
        return None
    end = next((a for a in record.get("answer_attribution") or [] if a.get("is_terminal")), None)
    meta = {k: v for k, v in (("is_correct", e.get("is_correct")), ("extraction_method", (end or {}).get("extraction_method"))) if v is not None}
    return {"scorer": record.get("evaluation_name") or "evaluation", "value": e.get("score", 0.0), "answer": (end or {}).get("extracted_value"), "metadata": meta}


def record_sample(record: dict[str, Any]) -> dict[str, Any]:
    """Scalars of a sample: a target only if there is exactly one reference."""
    references = (record.get("input") or {}).get("reference") or []
    usage, evaluation = record.get("token_usage") or {}, record.get("evaluation") or {}
    meta = {
        "formatted_input": (record.get("input") or {}).get("formatted"), "num_turns": evaluation.get("num_turns"), "tool_calls_count": evaluation.get("tool_calls_count"), "reasoning_tokens": usage.get("reasoning_tokens"),
        "performance": record.get("performance"), "eval_metadata": record.get("metadata"), "interaction_type": record.get("interaction_type"), "sample_hash": record.get("sample_hash"), "choices": (record.get("input") or {}).get("choices"),
        "references": references or None, "intermediate_answers": [a for a in record.get("answer_attribution") or [] if not a.get("is_terminal")] or None,
    }
    return {"sample_id": str(record.get("sample_id")), "target": references[0] if len(references) == 1 else None, "error": record.get("error"), "input_tokens": usage.get("input_tokens"), "output_tokens": usage.get("output_tokens"), "metadata": {k: v for k, v in meta.items() if v is not None}}


def _parts(content: Any) -> tuple[str, str]:
    """Text and reasoning of a message content that may be a list of parts."""
    if isinstance(content, str) or content is None:
        return content or "", ""
    text = "".join(p.get("text", "") for p in content if p.get("type", "text") == "text")
    return text, "".join(p.get("reasoning") or p.get("text", "") for p in content if p.get("type") == "reasoning")


def log_sample(sample: dict[str, Any]) -> dict[str, Any]:
    """One sample of an eval log: messages, scores, logprobs, scalars."""
    messages = []
    for m in sample.get("messages") or []:
        content, reasoning = _parts(m.get("content"))
        calls = [{"id": c.get("id"), "name": c.get("function") or c.get("name"), "arguments": c.get("arguments")} for c in m.get("tool_calls") or []]
        extra = {k: m[k] for k in ("tool_call_id", "function") if m.get(k)}
        messages.append({"role": m.get("role"), "content": content, **({"reasoning": reasoning} if reasoning else {}), **({"tool_calls": calls} if calls else {}), **extra})
    scores = [{"scorer": k, "value": v.get("value"), "answer": v.get("answer"), "explanation": v.get("explanation"), "metadata": v.get("metadata") or {}} for k, v in (sample.get("scores") or {}).items()]
    choice = next(iter((sample.get("output") or {}).get("choices") or []), {})
    content = (choice.get("logprobs") or {}).get("content")
    target, usage = sample.get("target"), sample.get("usage") or {}
    return {
        "sample_id": str(sample.get("id")), "messages": messages, "scores": scores, "logprobs": [x.get("logprob") for x in content] if content else None,
        "target": target if isinstance(target, str) or target is None else json.dumps(target), "error": _text(sample.get("error")) or None, "input_tokens": usage.get("input_tokens"), "output_tokens": usage.get("output_tokens"), "metadata": sample.get("metadata") or {},
    }


def log_metadata(log: dict[str, Any]) -> dict[str, Any]:
    """Document metadata of an eval log; plan settings win over the eval's, the run time is in seconds."""
    e, plan, stats = log.get("eval") or {}, log.get("plan") or {}, log.get("stats") or {}
    config = {k: v for source in (e.get("model_generate_config") or {}, plan.get("config") or {}) for k, v in source.items() if v is not None}
    begun, ended = stats.get("started_at"), stats.get("completed_at")
    total = (datetime.fromisoformat(ended) - datetime.fromisoformat(begun)).total_seconds() if begun and ended else None
    source = {k: e[k] for k in ("task", "task_version", "eval_id", "run_id") if e.get(k) is not None}
    return {"model": {"name": strip_provider(e.get("model") or "unknown"), "generation_config": config | {"preserve_reasoning": True}}, "source_eval": source, "created_at": begun, "total_time": total}


def aggregate_result(record: dict[str, Any], aggregate: dict[str, Any] | None) -> dict[str, Any]:
    """The aggregate's result for a record's evaluation_result_id, else its first."""
    results = (aggregate or {}).get("evaluation_results") or []
    return next((r for r in results if r.get("evaluation_result_id") == record.get("evaluation_result_id")), results[0] if results else {})


def model_name(records: list[dict[str, Any]], aggregate: dict[str, Any] | None = None) -> str:
    info = (aggregate or {}).get("model_info") or {}
    return info.get("id") or info.get("name") or next((r["model_id"] for r in records if r.get("model_id")), "unknown")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, json): .jsonl by lines (blank ones skipped), .json as a list, an object with ``instances``, or one record."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("json"))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.instances", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return whole.select(F.posexplode(listed).alias("ord", "v")).select(F.col("ord").cast("long").alias("ord"), F.to_json("v").alias("json"))


def read_eval_log(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """The samples (ord, json) of an eval log {eval, plan, stats, samples} and the document's metadata; samples are not collected."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    parts = {k: F.to_json(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in ("eval", "plan", "stats")}
    head = whole.select(*parts.values()).first()
    if head is None or head["eval"] is None:
        raise ValueError(f"{path} is no eval log")
    samples = F.coalesce(F.try_variant_get("v", "$.samples", "array<variant>"), F.array().cast("array<variant>"))
    rows = whole.select(F.posexplode(samples).alias("ord", "v")).select(F.col("ord").cast("long").alias("ord"), F.to_json("v").alias("json"))
    return rows, log_metadata({k: json.loads(head[k]) for k in parts if head[k]})


def whole_content(messages: DataFrame) -> DataFrame:
    """``messages`` whose content holds the reasoning before it and the tool calls after it, as they are rendered."""
    section = F.when(F.col("tool_calls").isNotNull(), F.array_join(F.transform(F.from_json("tool_calls", "array<struct<name:string,arguments:string>>"), lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.lit(": "), F.coalesce(c["arguments"], F.lit("null")))), "\n"))
    content = F.coalesce("content", F.lit(""))
    thought = F.when(F.coalesce("reasoning", F.lit("")) != "", F.concat(F.lit("<think>\n"), "reasoning", F.lit("\n</think>\n"))).otherwise(F.lit(""))
    called = F.when(F.coalesce(section, F.lit("")) == "", content).when(content == "", section).otherwise(F.concat(content, F.lit("\n"), section))
    return messages.withColumn("content", F.concat(thought, called))


MESSAGES = "sample_ord long, sample_id string, turn long, role string, content string, reasoning string, tool_calls string"


def _project(kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for k, j in zip(frame["ord"], frame["json"]):
                r = json.loads(j)
                eval_log = "messages" in r and "interaction_type" not in r and "input" not in r
                s = log_sample(r) if eval_log else record_sample(r)
                if kind == "messages":
                    for t, m in enumerate(s["messages"] if eval_log else record_messages(r)):
                        rows.append((k, s["sample_id"], t, m["role"], m["content"], m.get("reasoning"), json.dumps(m["tool_calls"], ensure_ascii=False) if m.get("tool_calls") else None))
                elif kind == "scores":
                    for t, c in enumerate(s["scores"] if eval_log else filter(None, [record_score(r)])):
                        rows.append((s["sample_id"], t, c["scorer"], json.dumps(c["value"]), c.get("answer"), c.get("explanation"), json.dumps(c.get("metadata") or {})))
                elif kind == "logprobs":
                    rows += [(s["sample_id"], i, v) for i, v in enumerate(s.get("logprobs") or [])]
                else:
                    rows.append((k, s["sample_id"], s["target"], s["error"], s["input_tokens"], s["output_tokens"], json.dumps(s["metadata"], ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=COLUMNS[kind])

    return run


COLUMNS = {
    "messages": ["sample_ord", "sample_id", "turn", "role", "content", "reasoning", "tool_calls"], "scores": ["sample_id", "score_ord", "scorer", "value", "answer", "explanation", "metadata"],
    "logprobs": ["sample_id", "k", "logprob"], "samples": ["sample_ord", "sample_id", "target", "error", "input_tokens", "output_tokens", "metadata"],
}


def project(records: DataFrame, kind: str) -> DataFrame:
    """``messages``, ``scores``, ``samples`` or ``logprobs`` of records (ord, json)."""
    from ..operators.traces import SAMPLES, SCORES

    schema = {"messages": MESSAGES, "scores": SCORES, "samples": SAMPLES, "logprobs": "sample_id string, k long, logprob double"}[kind]
    return records.select("ord", "json").mapInPandas(_project(kind), schema)


def records_to_traces(records: DataFrame, min_length: int = 5, dedup: bool = True, roles: bool = True, generated: bool = True, logprobs: bool = True, metadata: dict[str, Any] | None = None, tokenizer: str | None = None):
    """A bundle of records: rendered with reasoning and tool calls, tokenized, the reply and its logprobs marked before runs collapse, roles after.

    Without a ``tokenizer`` file each character is a token.
    """
    from dataclasses import replace

    from ..operators import chat
    from ..session import cut

    plain = cut(project(records, "messages"))
    m = whole_content(plain).drop("reasoning", "tool_calls")
    base = chat.chat_traces(m, tokenizer=tokenizer)
    ts = replace(base, metadata=metadata or base.metadata, samples=project(records, "samples"), scores=project(records, "scores")).cut()
    if generated:
        ts = chat.tag_generated(ts, plain, chat.render(m))
        if logprobs:
            ts = ts.attach_logprobs(project(records, "logprobs"))
        ts = ts.cut()
    if dedup:
        ts = ts.deduplicate_sequences(min_length).cut()
    return chat.tag_chat_roles(ts, m) if roles else ts


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(sample_ord, sample_id, text): one sample a file, named by it, in name order; ValueError if there is none."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("sample_id"), F.col("value").alias("text"))
    if files.isEmpty():
        raise ValueError(f"no file matches {pattern} in {path}")
    names = running_sum(files.select("sample_id"), ["sample_id"], F.lit(1), "k").select("sample_id", (F.col("k") - 1).cast("long").alias("sample_ord"))
    return files.join(names, "sample_id").select("sample_ord", "sample_id", "text")

