"""Offline tokenizers as column expressions, and the offsets of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sum

#: Lossless: leading white space stays with the word, trailing white space is a token of its own.
WORD_PATTERN = "[ \\t\\r\\n]*[^ \\t\\r\\n]+|[ \\t\\r\\n]+"


def token_id(token: Column) -> Column:
    """A token's id without a vocabulary pass: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), 0)


def char_tokens(text: Column) -> Column:
    """One token per code point; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != "")


def explode_tokens(samples: DataFrame, keys: list[str], tokens: Column, char_ids: bool = False) -> DataFrame:
    """(keys, pos, id, token): one row a token, ids by code point or by ``token_id``."""
    rows = samples.select(*keys, F.posexplode(tokens).alias("p", "token"))
    ids = F.ascii("token").cast("long") if char_ids else token_id(F.col("token"))
    return rows.select(*keys, F.col("p").cast("long").alias("pos"), ids.alias("id"), "token")


def char_offsets(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` with c_start and c_end, the code-point offsets in the joined text."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("token").cast("long")).over(w)
    return tokens.withColumn("c_end", end).withColumn("c_start", F.col("c_end") - F.length("token"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, vocab_id, n): dense ids in binary order of the distinct tokens."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return running_sum(counts, ["token"], F.lit(1), "k").select("token", (F.col("k") - 1).cast("long").alias("vocab_id"), "n")
