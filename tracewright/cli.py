"""``python -m tracewright.cli view|convert``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.traces import TraceSet
from .sources import documents, records
from .viewer import save_html


def _out(path: str, given: str | None, suffix: str, many: bool) -> str:
    """The output of one input; a name given for several inputs is a folder."""
    name = os.path.splitext(os.path.basename(path))[0] + suffix
    return os.path.join(given, name) if given and many else given or os.path.join(os.path.dirname(path), name)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewright")
    commands = p.add_subparsers(dest="command", required=True)
    view = commands.add_parser("view", help="write an HTML page")
    view.add_argument("path")
    view.add_argument("-o", "--output")
    view.add_argument("--compact", action="store_true")
    kinds = commands.add_parser("convert", help="make a document").add_subparsers(dest="kind", required=True)
    for kind in ("txt", "records", "eval"):
        c = kinds.add_parser(kind)
        c.add_argument("paths", nargs="+")
        c.add_argument("-o", "--output")
        c.add_argument("--pattern", default="*.txt")
        c.add_argument("--format", default="trz", choices=["json", "trz", "parquet"])
        c.add_argument("--min-length", type=int, default=5)
        c.add_argument("--no-dedup", action="store_true")
        c.add_argument("--tokenizer", help="a tokenizer file; without one txt has words, the others have characters")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tracewright").getOrCreate()
    if a.command == "view":
        save_html(documents.load(spark, a.path), a.output or os.path.splitext(a.path)[0] + ".html", a.compact)
        return 0
    for path in a.paths:
        try:
            if a.kind == "txt":
                ts = TraceSet.from_texts(records.read_text_files(spark, path, a.pattern), tokenizer=a.tokenizer)
                ts = ts if a.no_dedup else ts.deduplicate_sequences(a.min_length)
            else:
                rows, metadata = records.read_eval_log(spark, path) if a.kind == "eval" else (records.read_records(spark, path), None)
                ts = records.records_to_traces(rows, a.min_length, not a.no_dedup, metadata=metadata, tokenizer=a.tokenizer)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        documents.save(ts, _out(path.rstrip("/"), a.output, f".{a.format}", len(a.paths) > 1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
