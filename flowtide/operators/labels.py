"""Label mapping: text label -> key -> class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import normalize_label
from flowtide.session import BROADCAST_ROWS

def with_label_key(df: DataFrame, raw: str = "raw_label") -> DataFrame:
    return df.withColumn("label_key", normalize_label(raw))


def bounded_dimension(dim: DataFrame) -> DataFrame:
    """Broadcast hint, given only after the dimension was counted."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def map_label(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``unified_label``; null where the (year, key) pair is unknown."""
    return df.join(bounded_dimension(dim), ["source_year", "label_key"], "left")


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Drop header lines repeated inside the data."""
    return df.where(F.col("label_key").isNull() | (F.col("label_key") != S.HEADER_KEY))


def drop_unmapped(df: DataFrame) -> DataFrame:
    return df.where(F.col("unified_label").isNotNull())


def clean_labels(df: DataFrame, dim: DataFrame, raw: str = "raw_label") -> DataFrame:
    """Key, map and drop in one step: an inner join, since unmapped rows go anyway.

    A header row has no entry in the map, so the join removes it too.  Rows without
    a label go first and the key is declared never null, or the null test that the
    optimizer puts before the join would compute it a second time.
    """
    key = F.coalesce(normalize_label(raw), F.lit(""))
    keyed = df.where(F.col(raw).isNotNull()).withColumn("label_key", key)
    return keyed.join(bounded_dimension(dim), ["source_year", "label_key"], "inner")
