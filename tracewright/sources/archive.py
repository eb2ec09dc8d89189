"""Indexed archives: a zip with one member per sample, a manifest, and a journal to recover from.

Members: journal/start.json (metadata and format), sequences.json, samples/NNNNNNNN.json (deflated),
journal/summaries/NNNNNNNN.json (stored), and manifest.json, written on close. Without a manifest the journal is read,
so an interrupted archive keeps the samples it has.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.jsontext import compact
from ..operators.summary import PREVIEW_CHARS
from ..operators.traces import TraceSet

FORMAT, VERSION = "tracewright-archive", 1
MEMBERS_A_PARTITION = 64


def summary_of(sample: dict[str, Any], preview: int = PREVIEW_CHARS) -> dict[str, Any]:
    """What the manifest says of a sample; tokens count natively, the preview is its top texts."""
    scores = [{k: s[k] for k in ("scorer", "value", "answer") if s.get(k) is not None} for s in sample.get("scores", [])]
    out = {"id": str(sample["id"]), "n_tokens": len(sample.get("tokens", [])), "n_texts": len(sample.get("texts", [])), "n_spans": len(sample.get("spans", [])), "scores": scores}
    out["text_preview"] = "\n".join(t.get("value", "") for t in sample.get("texts", []))[:preview]
    return out | {k: sample[k] for k in ("target", "error", "input_tokens", "output_tokens") if sample.get(k) is not None}


class ArchiveWriter:
    """Writes samples as they come; ``flush`` makes them durable, ``close`` adds the manifest."""

    def __init__(self, path: str, metadata: dict[str, Any], sequences: list[dict[str, Any]] | None = None, compacted: bool = True, compression: int = zipfile.ZIP_DEFLATED, preview: int = PREVIEW_CHARS):
        self.path, self.compacted, self.compression, self.preview = path, compacted, compression, preview
        self.entries: list[dict[str, Any]] = []
        self._zip: zipfile.ZipFile | None = zipfile.ZipFile(path, "w", compression)
        self._put("journal/start.json", {"format": FORMAT, "version": VERSION, "metadata": metadata}, zipfile.ZIP_STORED)
        self._put("sequences.json", sequences or [], compression)
        self.metadata = metadata

    def _put(self, name: str, value: Any, how: int) -> None:
        if self._zip is None:
            raise ValueError("the archive is closed")
        self._zip.writestr(name, json.dumps(value, ensure_ascii=False).encode("utf-8"), how)

    def write_sample(self, sample: dict[str, Any]) -> None:
        k = len(self.entries)
        entry = {"index": k, "path": f"samples/{k:08d}.json", **summary_of(sample, self.preview)}
        self._put(entry["path"], compact(sample) if self.compacted else sample, self.compression)
        self._put(f"journal/summaries/{k:08d}.json", entry, zipfile.ZIP_STORED)
        self.entries.append(entry)

    def flush(self) -> None:
        if self._zip is not None:
            self._zip.close()
            self._zip = zipfile.ZipFile(self.path, "a", self.compression)

    def close(self) -> None:
        if self._zip is not None:
            self._put("manifest.json", {"format": FORMAT, "version": VERSION, "metadata": self.metadata, "samples": self.entries}, self.compression)
            self._zip.close()
            self._zip = None

    def __enter__(self) -> ArchiveWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def save_archive(ts: TraceSet, path: str, **options: Any) -> None:
    """Samples are built by the executors and pass through the driver one at a time, as a zip is one file."""
    from .documents import sample_dicts, sequence_dicts

    with ArchiveWriter(path, ts.metadata, sequence_dicts(ts), **options) as w:
        for s in sample_dicts(ts):
            w.write_sample(s)


def _read(z: zipfile.ZipFile, name: str) -> Any:
    return json.loads(z.read(name).decode("utf-8"))


def manifest(z: zipfile.ZipFile) -> dict[str, Any]:
    names = set(z.namelist())
    if "manifest.json" in names:
        out = _read(z, "manifest.json")
    else:
        out = _read(z, "journal/start.json") | {"samples": [_read(z, n) for n in sorted(names) if n.startswith("journal/summaries/")]}
    if (out.get("format"), out.get("version")) != (FORMAT, VERSION):
        raise ValueError(f"{z.filename} is not an archive of version {VERSION}")
    ids = [e["id"] for e in out["samples"]]
    if len(set(ids)) != len(ids):
        raise ValueError(f"{z.filename} holds a sample id twice")
    return out


def read_info(path: str) -> dict[str, Any]:
    with zipfile.ZipFile(path) as z:
        m = manifest(z)
    return {"metadata": m["metadata"], "samples": [{k: v for k, v in e.items() if k not in ("path", "index")} for e in m["samples"]]}


def read_header(path: str) -> dict[str, Any]:
    """Metadata and sequences, no samples."""
    with zipfile.ZipFile(path) as z:
        return {"metadata": manifest(z)["metadata"], "sequences": _read(z, "sequences.json")}


def iter_archive(path: str) -> Iterator[dict[str, Any]]:
    with zipfile.ZipFile(path) as z:
        for e in manifest(z)["samples"]:
            yield _read(z, e["path"])


def read_archive_samples(path: str, ids: list[str]) -> list[dict[str, Any]]:
    with zipfile.ZipFile(path) as z:
        at = {e["id"]: e["path"] for e in manifest(z)["samples"]}
        if lost := [i for i in ids if i not in at]:
            raise KeyError(", ".join(lost))
        return [_read(z, at[i]) for i in ids]


def load_archive(spark: SparkSession, path: str, sample_ids: list[str] | None = None) -> TraceSet:
    """The whole archive, or some samples with the sequences they refer to."""
    from .documents import from_dict

    head = read_header(path)
    samples = list(iter_archive(path)) if sample_ids is None else read_archive_samples(path, [str(i) for i in sample_ids])
    ts = from_dict(spark, {**head, "samples": samples})
    return ts if sample_ids is None else ts.prune_sequences()


class _Members(InputPartition):
    def __init__(self, entries: list[tuple[int, str, str]]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.ids = set(json.loads(options["ids"])) if "ids" in options else None

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            entries = [(e["index"], e["id"], e["path"]) for e in manifest(z)["samples"] if self.ids is None or e["id"] in self.ids]
        return [_Members(entries[i : i + MEMBERS_A_PARTITION]) for i in range(0, len(entries), MEMBERS_A_PARTITION)] or [_Members([])]

    def read(self, partition: _Members) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            for k, sid, name in partition.entries:
                yield k, sid, z.read(name).decode("utf-8")


class ArchiveSource(DataSource):
    """``spark.read.format("tracewright_archive").load(path)``: (sample_ord, sample_id, json), members split over tasks.

    The option ``ids`` (a JSON list) reads only those members. Filters aren't taken over from plans.
    """

    @classmethod
    def name(cls) -> str:
        return "tracewright_archive"

    def schema(self) -> str:
        return "sample_ord long, sample_id string, json string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
