"""Streams of new texts: running tag counts, and archives that grow batch by batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.regex import matches
from ..functions.tokens import explode_tokens, word_tokens


def read_texts(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tag_counts(texts: DataFrame, tags: Iterable[tuple[str, str]], id_column: str = "doc_id") -> DataFrame:
    """(name, n): tokens with each tag so far; every pattern in one scan, state is one counter a tag."""
    tokens = explode_tokens(texts.select(F.col(id_column).cast("string").alias("sample_id"), "text"), ["sample_id"], word_tokens(F.col("text")))
    hit = F.filter(F.array(*(F.when(matches(F.col("token"), p), F.lit(t)) for p, t in tags)), lambda x: x.isNotNull())
    return tokens.select(F.explode(F.array_distinct(hit)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events per window; those later than the watermark are dropped by Spark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def archive_stream(texts: DataFrame, folder: str, checkpoint: str, id_column: str = "doc_id") -> StreamingQuery:
    """Write each micro-batch as an archive of its own, named by the batch, so a repeated batch replaces itself."""
    from ..operators.traces import TraceSet
    from ..sources.archive import save_archive

    def put(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            rows = batch.select(F.col(id_column).cast("long").alias("sample_ord"), F.col(id_column).cast("string").alias("sample_id"), "text")
            save_archive(TraceSet.from_texts(rows), f"{folder}/batch-{epoch:08d}.trz")

    return texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
