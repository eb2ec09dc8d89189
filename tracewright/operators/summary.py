"""Summaries of samples and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import TraceSet

PREVIEW_CHARS = 1000


def sample_summaries(ts: TraceSet, preview: int = PREVIEW_CHARS) -> DataFrame:
    """(sample_ord, sample_id, n_tokens, n_texts, n_spans, n_scores, text_preview, target, error, input_tokens, output_tokens)."""
    count = lambda df, name: df.groupBy("sample_id").agg(F.count("*").alias(name))
    top = ts.texts.where("parent IS NULL")
    shown = top.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("t"))
    shown = shown.select("sample_id", F.array_join("t.value", "\n").substr(1, preview).alias("text_preview"))
    spans = ts.spans.select("sample_id", "span_ord").distinct()
    out = ts.samples
    for df in (count(ts.tokens, "n_tokens"), count(top, "n_texts"), count(spans, "n_spans"), count(ts.scores, "n_scores"), shown):
        out = out.join(df, "sample_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_texts", "n_spans", "n_scores")]
    return out.select("sample_ord", "sample_id", *zero, F.coalesce("text_preview", F.lit("")).alias("text_preview"), "target", "error", "input_tokens", "output_tokens")


def score_correct(value: Column, metadata: Column) -> Column:
    """True, false or null (can't tell) of a score: metadata.is_correct, then "C" or "I", then one or zero, booleans too."""
    flag = F.get_json_object(metadata, "$.is_correct")
    v = F.trim(value)
    return (
        F.when(flag.isin("true", "false"), flag == "true").when(v == '"C"', True).when(v == '"I"', False)
        .when(v == "true", True).when(v == "false", False).when(v.rlike(r"^1(\.0*)?$"), True).when(v.rlike(r"^-?0(\.0*)?$"), False)
    )


def sample_verdicts(ts: TraceSet) -> DataFrame:
    """(sample_id, verdict): the first score that can tell, in order; null if none can."""
    judged = ts.scores.withColumn("ok", score_correct(F.col("value"), F.col("metadata"))).where("ok IS NOT NULL")
    first = judged.groupBy("sample_id").agg(F.min_by("ok", "score_ord").alias("verdict"))
    return ts.samples.select("sample_id").join(first, "sample_id", "left")


def extra_names(ts: TraceSet) -> DataFrame:
    """(sample_id, key): the names of extras in each sample."""
    return ts.tokens.select("sample_id", F.explode(F.json_object_keys("extras")).alias("key")).distinct()


def length_stats(lengths: DataFrame, by: list[str], column: str = "n") -> DataFrame:
    """Mean, exact median, least and greatest of a count."""
    return lengths.groupBy(*by).agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.min(column).alias("least"), F.max(column).alias("greatest"))


def relative_positions(positions: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sample_id, rel, bucket): a position over its sample's length, in quarters (the last one closed)."""
    j = positions.join(lengths, "sample_id").where("n > 0").withColumn("rel", F.col("pos") / F.col("n"))
    return j.select("sample_id", "rel", F.when(F.col("rel") < 0.25, 0).when(F.col("rel") < 0.5, 1).when(F.col("rel") < 0.75, 2).otherwise(3).cast("long").alias("bucket"))


def convergence_layers(tokens: DataFrame) -> DataFrame:
    """(sample_id, pos, layer): the first layer whose top token in data.logit_lens is the token itself."""
    layers = F.from_json(F.get_json_object("extras", "$.data.logit_lens"), "map<string,struct<top_token:string>>")
    rows = tokens.where("extras IS NOT NULL").select("sample_id", "pos", "token", F.explode(layers).alias("name", "top"))
    hit = rows.where(F.col("top.top_token") == F.col("token"))
    return hit.groupBy("sample_id", "pos").agg(F.min(F.regexp_extract("name", "([0-9]+)$", 1).cast("long")).alias("layer"))
