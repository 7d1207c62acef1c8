"""Class counts kept by increments: a stored table of partial counts, one part per micro-batch.

A run reads the files that arrived since the last one and adds their counts per
file.  A part carries its batch number and replaces what an earlier try of the
same batch wrote, so a repeated batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "file_name string, source_year int, unified_label string, rows long"


def add_files(stream: DataFrame, path: str, checkpoint: str, label: str = "unified_label", by: str = "source_year") -> None:
    """Count the new files of a file stream into the table at ``path`` and wait for it."""
    named = stream.select(F.col("_metadata.file_name").alias("file_name"), F.col(by).alias("source_year"), F.col(label).alias("unified_label"))
    add_rows(named, path, checkpoint)


def add_rows(named: DataFrame, path: str, checkpoint: str) -> None:
    """As ``add_files``, for a stream of (file_name, source_year, unified_label)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("file_name", "source_year", "unified_label").agg(F.count(F.lit(1)).alias("rows"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, source_year, unified_label, rows) so far; a file split over batches is one row per class."""
    parts = spark.read.schema(PARTS + ", batch long").parquet(path)
    return parts.groupBy("file_name", "source_year", "unified_label").agg(F.sum("rows").alias("rows"))


def class_totals(counts: DataFrame) -> DataFrame:
    """The batch operator's ``class_counts`` by year, from the stored counts."""
    return counts.groupBy("source_year", "unified_label").agg(F.sum("rows").alias("rows"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged counts as one part, for a new table that goes on from there under a new checkpoint."""
    read_counts(spark, path).write.parquet(f"{target}/batch=-1")
