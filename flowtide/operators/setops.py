"""Bag union and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators.quality import schema_guard


def union_sources(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; differing column sets are an error."""
    first = tables[0]
    return reduce(lambda a, b: a.unionByName(schema_guard(b, first.columns)), tables[1:], first)


def key_set_ops(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every distinct key with the side it occurs on: both, a_only or b_only.

    One aggregate instead of three joins; repeated keys collapse before the
    shuffle.
    """
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    seen = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = (F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both")
            .when(F.col("_a") == 1, "a_only").otherwise("b_only"))
    return seen.select(*keys, side.alias("side"))
