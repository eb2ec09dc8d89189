"""Whole documents as Python objects and JSON files, and bundles as Parquet.

A JSON document is one file and passes through the driver; Parquet is the form for scale.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import compact, pretty
from ..operators.summary import sample_summaries
from ..operators.traces import TraceSet

TABLES = ("samples", "tokens", "sequences", "sequence_tokens", "annotations", "spans", "texts", "scores")
FORMAT_VERSION = "0.1"


def nested_samples(ts: TraceSet) -> DataFrame:
    """(sample_ord, sample_id, json): each sample as one JSON object, built by the executors."""

    def packed(df: DataFrame, name: str, order: list[str], body: dict[str, Any]) -> DataFrame:
        entry = F.struct(*(F.col(c) for c in order), F.to_json(F.struct(*(v.alias(k) for k, v in body.items()))).alias("j"))
        rows = df.groupBy("sample_id").agg(F.sort_array(F.collect_list(entry)).alias("x"))
        return rows.select("sample_id", F.concat(F.lit("["), F.array_join("x.j", ","), F.lit("]")).alias(name))

    raw = lambda c: F.parse_json(F.coalesce(c, F.lit("{}")))
    ann = ts.annotations.groupBy("sample_id", "ann_ord", "name", "metadata").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("ranges"))
    spans = ts.spans.groupBy("sample_id", "span_ord", "name", "tags").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    parts = [
        packed(ts.tokens, "tokens", ["pos"], {"token": F.col("token"), "id": F.col("id"), "extras": raw(F.col("extras"))}),
        packed(ann, "annotations", ["ann_ord"], {"name": F.col("name"), "ranges": F.col("ranges"), "metadata": raw(F.col("metadata"))}),
        packed(spans, "spans", ["span_ord"], {"name": F.col("name"), "positions": F.col("positions"), "tags": F.parse_json(F.coalesce("tags", F.lit("[]")))}),
        packed(ts.texts, "texts", ["path"], {"path": F.col("path"), "parent": F.col("parent"), "name": F.col("name"), "value": F.col("value"), "start": F.col("start"), "end": F.col("end"), "metadata": raw(F.col("metadata"))}),
        packed(ts.scores, "scores", ["score_ord"], {"scorer": F.col("scorer"), "value": F.parse_json("value"), "answer": F.col("answer"), "explanation": F.col("explanation"), "metadata": raw(F.col("metadata"))}),
    ]
    out = ts.samples
    for p in parts:
        out = out.join(p, "sample_id", "left")
    names = ("tokens", "annotations", "spans", "texts", "scores")
    head = F.to_json(F.struct(F.col("sample_id").alias("id"), "target", "error", "input_tokens", "output_tokens", raw(F.col("metadata")).alias("metadata")))
    body = F.concat(F.expr("substr(head, 1, length(head) - 1)"), *(x for n in names for x in (F.lit(f',"{n}":'), F.coalesce(n, F.lit("[]")))), F.lit("}"))
    return out.withColumn("head", head).select("sample_ord", "sample_id", body.alias("json"))


def _tidy(sample: dict[str, Any]) -> dict[str, Any]:
    """Extras beside token and id, and texts as a tree."""
    sample["tokens"] = [{"token": t["token"], **({"id": t["id"]} if t.get("id") is not None else {}), **t.get("extras", {})} for t in sample["tokens"]]
    nodes = {t["path"]: {**{k: v for k, v in t.items() if k not in ("path", "parent")}, "children": []} for t in sample["texts"]}
    roots = []
    for t in sample["texts"]:
        (nodes[t["parent"]]["children"] if t.get("parent") is not None and t["parent"] in nodes else roots).append(nodes[t["path"]])
    sample["texts"] = roots
    return sample


def sequence_dicts(ts: TraceSet) -> list[dict[str, Any]]:
    tokens: dict[str, list[dict[str, Any]]] = {}
    for r in ts.sequence_tokens.orderBy("seq_id", "seq_pos").collect():
        tokens.setdefault(r.seq_id, []).append({"token": r.token, "id": r.id})
    return [{"id": r.seq_id, "n_tokens": len(tokens.get(r.seq_id, [])), "tokens": tokens.get(r.seq_id, [])} for r in ts.sequences.orderBy("seq_ord").collect()]


def sample_dicts(ts: TraceSet) -> Iterator[dict[str, Any]]:
    """Samples in order, one at a time."""
    for r in nested_samples(ts).orderBy("sample_ord").toLocalIterator():
        yield _tidy(json.loads(r.json))


def to_dict(ts: TraceSet, compacted: bool = True) -> dict[str, Any]:
    out = {"metadata": {"format_version": FORMAT_VERSION, **ts.metadata}, "sequences": sequence_dicts(ts), "samples": list(sample_dicts(ts))}
    return compact(out) if compacted else out


def from_dict(spark: SparkSession, data: dict[str, Any]) -> TraceSet:
    """A bundle of a document; ValueError for what breaks the data model."""
    if "name" not in data.get("metadata", {}).get("model", {}):
        raise ValueError("metadata.model.name is required")
    rows: dict[str, list[tuple]] = {t: [] for t in TABLES}
    text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    for k, s in enumerate(data.get("sequences", [])):
        if s.get("n_tokens", len(s["tokens"])) != len(s["tokens"]):
            raise ValueError(f"sequence {s['id']}: n_tokens is not the number of tokens")
        rows["sequences"].append((k, str(s["id"])))
        rows["sequence_tokens"] += [(str(s["id"]), i, t["id"], t["token"]) for i, t in enumerate(s["tokens"])]
    for k, s in enumerate(data.get("samples", [])):
        if isinstance(s["id"], bool) or not isinstance(s["id"], (str, int)):
            raise ValueError(f"sample id {s['id']!r} is neither text nor a number")
        sid, n = str(s["id"]), len(s.get("tokens", []))
        rows["samples"].append((k, sid, s.get("target"), s.get("error"), s.get("input_tokens"), s.get("output_tokens"), text(s.get("metadata", {}))))
        for i, t in enumerate(s.get("tokens", [])):
            if t.get("id") is None and not t["token"]:
                raise ValueError(f"sample {sid}: token {i} has neither text nor id")
            bag = {a: b for a, b in t.items() if a not in ("token", "id")}
            rows["tokens"].append((sid, i, t.get("id"), t["token"], text(bag) if bag else None))
        names = [a["name"] for a in s.get("annotations", [])]
        if len(set(names)) != len(names):
            raise ValueError(f"sample {sid}: annotation names repeat")
        for j, a in enumerate(s.get("annotations", [])):
            for b, e in a.get("ranges", []):
                if not 0 <= b < e <= n:
                    raise ValueError(f"sample {sid}: annotation {a['name']} [{b}, {e}) is not inside {n} tokens")
                rows["annotations"].append((sid, j, a["name"], b, e, text(a.get("metadata", {}))))
        for j, p in enumerate(s.get("spans", [])):
            if any(not 0 <= x < n for x in p["positions"]):
                raise ValueError(f"sample {sid}: span {p['name']} is not inside {n} tokens")
            rows["spans"] += [(sid, j, p["name"], x, text(p.get("tags", []))) for x in p["positions"]]

        def walk(node: dict[str, Any], path: str, parent: str | None, lo: int | None, hi: int | None) -> None:
            b, e = node.get("start"), node.get("end")
            if (b is None) != (e is None) or (b is not None and not 0 <= b <= e) or (b is not None and lo is not None and not (lo <= b and e <= hi)):
                raise ValueError(f"sample {sid}: text {node['name']} has wrong offsets")
            rows["texts"].append((sid, path, parent, node["name"], node.get("value", ""), b, e, text(node.get("metadata", {}))))
            for j, child in enumerate(node.get("children", [])):
                walk(child, f"{path}.{j:08d}", path, b, e)

        for j, node in enumerate(s.get("texts", [])):
            walk(node, f"{j:08d}", None, None, None)
        rows["scores"] += [(sid, j, c["scorer"], text(c.get("value")), c.get("answer"), c.get("explanation"), text(c.get("metadata", {}))) for j, c in enumerate(s.get("scores", []))]
    from ..operators import traces as T

    schema = {"samples": T.SAMPLES, "tokens": T.TOKENS, "sequences": T.SEQUENCES, "sequence_tokens": T.SEQUENCE_TOKENS, "annotations": T.ANNOTATIONS, "spans": T.SPANS, "texts": T.TEXTS, "scores": T.SCORES}
    meta = {k: v for k, v in data["metadata"].items() if k != "format_version"}
    return TraceSet(*(spark.createDataFrame(rows[t], schema[t]) for t in TABLES), metadata=meta)


def save_json(ts: TraceSet, path: str, compacted: bool = True, indent: int | None = 4) -> None:
    data = to_dict(ts, compacted)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(data, ensure_ascii=False) if indent is None else pretty(data, indent))


def load_json(spark: SparkSession, path: str) -> TraceSet:
    with open(path, encoding="utf-8") as f:
        return from_dict(spark, json.load(f))


def save(ts: TraceSet, path: str, **options: Any) -> None:
    """By suffix: ``.json``, ``.trz`` (archive), ``.parquet`` (a folder of tables)."""
    if path.endswith(".json"):
        save_json(ts, path, **options)
    elif path.endswith(".trz"):
        from .archive import save_archive

        save_archive(ts, path, **options)
    elif path.endswith(".parquet"):
        for t in TABLES:
            getattr(ts, t).write.mode("overwrite").parquet(f"{path}/{t}")
        ts.tokens.sparkSession.createDataFrame([(json.dumps(ts.metadata),)], "metadata string").write.mode("overwrite").json(f"{path}/metadata")
    else:
        raise ValueError(f"{path}: the suffix is none of .json, .trz, .parquet")


def load(spark: SparkSession, path: str, sample_ids: list[str] | None = None) -> TraceSet:
    if path.endswith(".json"):
        return load_json(spark, path)
    if path.endswith(".trz"):
        from .archive import load_archive

        return load_archive(spark, path, sample_ids)
    if path.endswith(".parquet"):
        meta = json.loads(spark.read.json(f"{path}/metadata").first().metadata)
        return TraceSet(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), metadata=meta)
    raise ValueError(f"{path}: the suffix is none of .json, .trz, .parquet")


def iter_samples(spark: SparkSession, path: str) -> Iterator[dict[str, Any]]:
    """Samples in document order; an archive is read one by one, a JSON file as a whole."""
    if path.endswith(".trz"):
        from .archive import iter_archive

        yield from iter_archive(path)
    else:
        with open(path, encoding="utf-8") as f:
            yield from json.load(f)["samples"]


def read_samples(path: str, ids: Any) -> list[dict[str, Any]]:
    """The samples asked for, in that order; ids as text, repeated ones refused, missing ones a KeyError."""
    wanted = [str(i) for i in ([ids] if isinstance(ids, (str, int)) else ids)]
    if len(set(wanted)) != len(wanted):
        raise ValueError("sample ids repeat")
    if path.endswith(".trz"):
        from .archive import read_archive_samples

        return read_archive_samples(path, wanted)
    with open(path, encoding="utf-8") as f:
        found = {str(s["id"]): s for s in json.load(f)["samples"]}
    if lost := [i for i in wanted if i not in found]:
        raise KeyError(", ".join(lost))
    return [found[i] for i in wanted]


def read_info(spark: SparkSession, path: str) -> dict[str, Any]:
    """Metadata and sample summaries, without sequences; of an archive nothing else is read."""
    if path.endswith(".trz"):
        from .archive import read_info as archive_info

        return archive_info(path)
    ts = load(spark, path)
    return {"metadata": ts.metadata, "samples": [r.asDict() for r in sample_summaries(ts).orderBy("sample_ord").drop("sample_ord").collect()]}


def json_schema() -> dict[str, Any]:
    """JSON Schema of a document, with the usual token extras."""
    text, number, bag = {"type": "string"}, {"type": "integer"}, {"type": "object"}
    obj = lambda need, **p: {"type": "object", "properties": p, "required": need}
    arr = lambda x: {"type": "array", "items": x}
    token = {"type": "object", "properties": {"token": text, "id": {"type": ["integer", "null"]}, "logprob": {"type": "number"}, "logit_lens": bag}, "required": ["token"], "additionalProperties": True}
    score = obj(["scorer", "value"], scorer=text, value={"type": ["string", "integer", "number", "boolean", "array", "object"]}, answer=text, explanation=text, metadata=bag)
    node = {"$ref": "#/$defs/Text"}
    sample = obj(["id", "tokens"], id={"type": ["string", "integer"]}, tokens=arr(token), texts=arr(node), annotations=arr(obj(["name"], name=text, ranges=arr(arr(number)), metadata=bag)), spans=arr(obj(["name", "positions"], name=text, positions=arr(number), tags=arr(text), metadata=bag)), scores=arr(score), target=text, error=text, input_tokens=number, output_tokens=number, metadata=bag)
    defs = {"Text": obj(["name"], name=text, value=text, start={"type": ["integer", "null"]}, end={"type": ["integer", "null"]}, children=arr(node), metadata=bag)}
    sequence = obj(["id", "n_tokens", "tokens"], id=text, n_tokens=number, tokens=arr(token))
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": defs, **obj(["metadata"], metadata=obj(["model"], model=obj(["name"], name=text)), sequences=arr(sequence), samples=arr(sample))}


def write_schema(path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json_schema(), f, indent=2)
