"""Feature selection, missing-value policies, targets, vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import binary_target, class_code, inf_to_null, zero_if_missing
from flowtide.operators.quality import require_columns


def scan_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns a stage needs; Catalyst prunes the scan to them."""
    require_columns(df, columns)
    return df.select(*columns)


def select_golden12(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The twelve features plus class and lineage, after a presence check."""
    cols = (keep or []) + S.GOLDEN12 + ["unified_label", "source_year"]
    return scan_columns(df, cols)


def rates_inf_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: inf_to_null(c) for c in (columns or S.RATE_COLUMNS)})


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN feature."""
    return df.na.drop(subset=columns or S.GOLDEN12)


def impute_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Live policy: missing and infinite features become 0.0; absent columns are added."""
    cols = columns or S.GOLDEN12
    return df.withColumns({c: zero_if_missing(c) if c in df.columns else F.lit(0.0) for c in cols})


def encode_class(df: DataFrame, label: str = "unified_label") -> DataFrame:
    return df.withColumn("class_code", class_code(label))


def add_binary_target(df: DataFrame, label: str = "unified_label") -> DataFrame:
    return df.withColumn("target", binary_target(label))


def assemble_features(df: DataFrame, columns: list[str] | None = None, out: str = "features") -> DataFrame:
    """Ordered vector; a missing value is an error here, not a silent skip."""
    va = VectorAssembler(inputCols=columns or S.GOLDEN12, outputCol=out, handleInvalid="error")
    return va.transform(df)
