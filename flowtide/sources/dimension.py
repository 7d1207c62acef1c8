"""Label and class dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S

LABEL_DIM = T.StructType([
    T.StructField("source_year", T.IntegerType(), False),
    T.StructField("label_key", T.StringType(), False),
    T.StructField("unified_label", T.StringType(), False),
])


def label_dimension(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(source_year, label_key, unified_label): the built-in map, or one stored as JSON.

    The JSON holds one object per year, ``{"2017": {key: class}, ...}``;
    other entries are ignored.
    """
    if path is None:
        rows = [(y, k, c) for y, m in S.LABEL_MAP.items() for k, c in m.items()]
        return spark.createDataFrame(rows, LABEL_DIM)
    text = spark.read.text(path, wholetext=True)
    top = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("year", "body"))
    years = top.where(F.col("year").rlike("^[0-9]{4}$"))
    pairs = years.select("year", F.explode(F.from_json("body", "map<string,string>")).alias("label_key", "unified_label"))
    return pairs.select(F.col("year").cast("int").alias("source_year"), "label_key", "unified_label")


def class_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.CLASS_CODES.items()), "unified_label string, class_code int")


def write_label_dimension(dim: DataFrame, path: str) -> None:
    """Store the map as JSON lines; it has a few dozen rows."""
    dim.coalesce(1).write.mode("overwrite").json(path)
