"""Cumulative-snapshot collapse and chat formatting, in DataFrame functions only.

A logged conversation that is a prefix of a longer one, or equal to another, is a snapshot
of it. The rolling hash of a prefix is the XOR of the hashes of its turns with their
positions, a window aggregate that needs no list of turns. A conversation whose whole hash
is the hash of a proper prefix somewhere goes by an anti-join; of equal ones the smallest
conv_id stays. What remains is rendered turn by turn.

Turns are numbered in two levels (blocks of ``BLOCK`` turn values, then offsets of blocks),
so that one conversation with a large share of all rows is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, table

BLOCK = 1024


def _blocks(turns: DataFrame) -> DataFrame:
    """The turns with their block and place in it, ordered by turn, role and text."""
    t = turns.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    return t.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")))


def _prefixes(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, h1, h2), the hashes of each prefix; and (conv_id, block, offset), the turns before each block. No text is written."""
    # Null and empty differ, and no content can shift between role and text.
    content = [F.col("role").isNull(), F.col("text").isNull(), F.length("role"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    hashed = _blocks(turns).select("conv_id", "block", "at", F.xxhash64(F.lit(1), *content).alias("c1"), F.xxhash64(F.lit(2), *content[::-1]).alias("c2"))
    hashed = scratch.save(hashed, "hashed", free=True)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    offsets = scratch.save(sizes.select("conv_id", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset")), "offsets", free=True)
    placed = hashed.join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("at") + F.col("offset"))
    placed = placed.withColumn("x1", F.xxhash64("pos", "c1")).withColumn("x2", F.xxhash64("c2", "pos"))
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "block", "pos", F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2"))
    rolled = scratch.save(rolled, "rolled", free=True)
    ends = rolled.groupBy("conv_id", "block").agg(F.max_by(F.struct("r1", "r2"), "pos").alias("r"))
    base = ends.select("conv_id", "block", F.coalesce(F.bit_xor("r.r1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("r.r2").over(before), F.lit(0)).alias("b2"))
    out = rolled.join(base, ["conv_id", "block"]).select("conv_id", "pos", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))
    out = scratch.save(out, "prefixes", free=True)
    scratch.drop("hashed", "rolled")
    return out, offsets


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of the maximal conversations of ``turns`` (conv_id, turn, role, text, ...).

    Turns are ordered by turn, then role and text, nulls first; pos counts from 1. Repeated
    rows are turns of their own. Null and empty roles or texts differ. Rows without a conv_id
    belong to no conversation and are left out. Other columns are unused, whatever their
    names; an empty table gives an empty result.
    """
    scratch = Scratch(turns.sparkSession, "snapshots")
    prefixes, offsets = _prefixes(turns, scratch)
    whole = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by(F.struct("h1", "h2"), "pos").alias("h")).select("conv_id", "n", "h.h1", "h.h2")
    whole = scratch.save(whole, "whole", free=True)
    proper = prefixes.join(whole.select("conv_id", "n"), "conv_id").where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    one_each = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    maximal = scratch.save(one_each.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id"), "maximal", free=True)
    scratch.drop("prefixes", "whole")
    left = _blocks(turns.join(maximal, "conv_id", "left_semi"))
    return left.join(offsets, ["conv_id", "block"]).select("conv_id", (F.col("at") + F.col("offset")).alias("pos"), "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, rendered): the marked-up turn; a null role is ``user``, a null text is empty."""
    return turns.select("conv_id", "pos", F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")).alias("rendered"))


def render_whole(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): a conversation's turns in one string, for conversations that fit into a row."""
    rows = render(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rendered"))).alias("t"))
    return rows.select("conv_id", F.array_join("t.rendered", "").alias("rendered"))


def op2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render(collapse(table(spark, sf_dir, "conversations")))
    part = F.conv(F.substring(F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("rendered")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("rendered").cast("long")).alias("n_chars"), F.sum(part).alias("digest"))


SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '~') AS r, coalesce(text, '~') AS x, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(md5(r || chr(1) || x), ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE pos = n GROUP BY prefix),
m AS (SELECT conv_id FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n)),
q AS (SELECT conv_id, pos, '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM p WHERE conv_id IN (SELECT conv_id FROM m))
SELECT conv_id, count(*) AS n_turns, CAST(sum(length(rendered)) AS BIGINT) AS n_chars, CAST(sum(CAST('0x' || md5(pos || ':' || rendered)[1:8] AS BIGINT)) AS BIGINT) AS digest FROM q GROUP BY conv_id"""
