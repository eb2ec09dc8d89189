"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.op01_lexicon_bpe import encode
from tracewright.llm.op05_minhash import near_duplicates
from tracewright.llm.op06_line_chunks import dedup_lines
from tracewright.llm.op08_spaced_seeds import decontaminate
from tracewright.llm.op09_cascade import keep_quality
from tracewright.llm.scratch import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line chunks that stand earlier in the corpus."""
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    judged = near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(judged, docs["doc_id"] == judged["__gone"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    out = encode(docs, decoded=True)
    n = F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("decontamination", benchmark),
    ("bpe", bpe),
]

#: MinHash, seed alignment and BPE aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
