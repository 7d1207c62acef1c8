"""Work over one total order without sending all rows to one task.

Rows are range-partitioned into balanced blocks and stored; windows then run
inside a block, and one row per block carries the state to the next block.
The carry table has as many rows as there are blocks, so it is small by
construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from flowtide.session import cut

BLOCK = "_block"


def ordered_blocks(df: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Add ``_block``: all rows of block i sort before all rows of block i+1.

    ``keys`` must end in a unique column, so that even a single repeated
    leading value spreads over many blocks.  The stored copy fixes the block
    numbers, which range sampling would otherwise draw anew on each use.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys])
    return cut(placed.withColumn(BLOCK, F.spark_partition_id()))


def block_window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(BLOCK).orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def carry_last(blocks: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Per block: the value of the last non-null row of all earlier blocks."""
    tails = blocks.where(value.isNotNull()).groupBy(BLOCK).agg(
        F.max_by(value, F.struct(*keys)).alias("_tail"))
    all_blocks = blocks.select(BLOCK).distinct().join(tails, BLOCK, "left")
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return all_blocks.select(BLOCK, F.last("_tail", ignorenulls=True).over(before).alias(name))


def carry_sum(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """Per block: the sum of ``value`` over all earlier blocks."""
    sums = blocks.groupBy(BLOCK).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(BLOCK, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))


def running_sum(blocks: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to and including this one.

    ``blocks`` comes from ``ordered_blocks`` by group and order.  A group may reach
    over any number of blocks: each adds up its own rows, and one row per block
    and group carries the rest.
    """
    inside = Window.partitionBy(BLOCK, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(BLOCK, *group).agg(F.sum(value).alias("_sum"))
    carry = sums.select(BLOCK, *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return blocks.withColumn("_inside", F.sum(value).over(inside)).join(carry, [BLOCK, *group]).withColumn(
        name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, without holding a group in one task.

    ``order`` must end in a column that is unique in the group; group columns are never null.
    """
    return running_sum(ordered_blocks(df, [*group, *order]), group, order, F.lit(1), name).drop(BLOCK)
