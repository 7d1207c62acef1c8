"""Decoded packet observations, one row per packet and capture point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ECHO_REQUEST, ECHO_REPLY = 8, 0


def read_packets(packets: DataFrame) -> DataFrame:
    """Echo requests only."""
    return packets.where(F.col("icmp_type") == ECHO_REQUEST)


def packet_counts(packets: DataFrame) -> DataFrame:
    """Per capture point: all packets, requests, replies and the rest."""
    kind = F.col("icmp_type")
    return packets.groupBy("point").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(kind == ECHO_REQUEST).alias("requests"),
        F.count_if(kind == ECHO_REPLY).alias("replies"),
        F.count_if(~kind.isin(ECHO_REQUEST, ECHO_REPLY) | kind.isNull()).alias("others"),
    )
