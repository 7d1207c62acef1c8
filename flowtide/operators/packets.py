"""Matching packet observations of two capture points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import micros
from flowtide.operators.setops import key_set_ops


def last_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``.

    An aggregate rather than a window, so repeats of a key shrink to one row
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*")


def match_packets(a: DataFrame, b: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Packets seen at both points with their latency in milliseconds.

    Both sides must hold one row per key (``last_write_wins``), so the join
    cannot fan out.
    """
    left = a.select(*keys, F.col(ts).alias("ts_a"))
    right = b.select(*keys, F.col(ts).alias("ts_b"))
    if dict(a.dtypes)[ts] == "double":
        latency = (F.col("ts_b") - F.col("ts_a")) * 1000
    else:
        latency = (micros("ts_b") - micros("ts_a")) / 1000
    return left.join(right, keys).withColumn("latency_ms", latency)


def unmatched_packets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen at both points, only at a, only at b."""
    side = F.col("side")
    return key_set_ops(a, b, keys).agg(
        F.count_if(side == "both").alias("both"),
        F.count_if(side == "a_only").alias("a_only"),
        F.count_if(side == "b_only").alias("b_only"),
    )
