"""Half-open ranges over positions: islands, merging, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, in the order given.

    Rows are parted by ranges of the order and summed within them; only the sums of the parts meet in one task.
    """
    parted = cut(rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("__part").agg(F.sum("__value").alias("__all")).select("__part", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__base"))
    inside = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # As small as the number of partitions.
    return parted.withColumn(name, inside).join(F.broadcast(base), "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__value", "__base")


def positions_to_ranges(positions: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, range_ord, start, end): runs of consecutive positions; repeated positions count once."""
    # dense_rank counts a repeated position once, so one shuffle by the keys serves all steps.
    p = positions.select(*keys, F.col(pos).cast("long").alias("p"))
    by = Window.partitionBy(*keys).orderBy("p")
    runs = p.withColumn("island", F.col("p") - F.dense_rank().over(by)).groupBy(*keys, "island").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    return runs.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("range_ord"), "start", "end")


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range_ord, start, end): empty ranges dropped, overlapping and touching ones joined."""
    r = ranges.where(F.col("start") < F.col("end")).select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    opened = r.withColumn("new", F.when(F.col("start") > F.max("end").over(before), 1).when(F.max("end").over(before).isNull(), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(*keys, (F.col("island") - 1).cast("long").alias("range_ord"), "start", "end")


def ranges_to_positions(ranges: DataFrame, keys: list[str], merged: bool = False) -> DataFrame:
    """(keys, pos): the distinct positions covered; an empty or reversed range covers none. ``merged`` ranges don't overlap, so nothing is shuffled."""
    spread = F.explode(F.when(F.col("start") < F.col("end"), F.sequence(F.col("start"), F.col("end") - 1)).otherwise(F.array().cast("array<bigint>")))
    spelled = ranges.select(*keys, spread.alias("pos"))
    return spelled if merged else spelled.distinct()
