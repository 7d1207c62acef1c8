"""Sinks. Tables are Parquet; metrics and manifests are small JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_flows(df: DataFrame, path: str) -> None:
    """Cleaned flows, replaced as a whole, one folder per source year."""
    df.write.mode("overwrite").partitionBy("source_year").parquet(path)


def write_splits(df: DataFrame, path: str, label: str = "unified_label", split: str = "split",
                 seed: str | int | None = None, ratios: dict[str, float] | None = None) -> DataFrame:
    """Write one folder per split below ``path`` and, beside them, a JSON manifest of what was written.

    The manifest is one record: seed, ratios, rows in total and per split, class
    shares of the whole in percent and the folder of each split.  It is written
    last, so a folder with a manifest is complete.  Returns the rows of
    ``split_manifest``.
    """
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    counts = split_manifest(stored, label, split)
    counts.write.mode("overwrite").parquet(f"{path}/_counts")
    counts = df.sparkSession.read.schema(counts.schema).parquet(f"{path}/_counts")
    split_record(counts, path, label, split, seed, ratios).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return counts


MANIFEST = ("random_seed string, ratios map<string,double>, row_counts map<string,bigint>, "
            "class_distribution_full_pct map<string,double>, output_files map<string,string>")


def split_record(counts: DataFrame, path: str, label: str = "unified_label", split: str = "split",
                 seed: str | int | None = None, ratios: dict[str, float] | None = None) -> DataFrame:
    """The manifest's record from the rows of ``split_manifest`` (one per split and class)."""
    per_split = counts.groupBy(split).agg(F.sum("rows").alias("rows"))
    shares = counts.groupBy(label).agg(F.first("class_pct_full").alias("pct"))
    pairs = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(k), F.lit("")), v))))
    sizes = per_split.agg(pairs(split, F.col("rows")).alias("of_split"), F.sum("rows").alias("total"),
                          pairs(split, F.concat(F.lit(f"{path}/{split}="), F.coalesce(F.col(split), F.lit("")))).alias("output_files"))
    named = F.create_map(*[F.lit(x) for k, v in (ratios or {}).items() for x in (k, float(v))]).cast("map<string,double>")
    return sizes.crossJoin(shares.agg(pairs(label, F.col("pct")).alias("class_distribution_full_pct"))).select(
        F.lit(None if seed is None else str(seed)).cast("string").alias("random_seed"), named.alias("ratios"),
        F.map_concat(F.create_map(F.lit("total"), F.coalesce("total", F.lit(0))), "of_split").alias("row_counts"),
        "class_distribution_full_pct", "output_files")


def read_manifest(spark, path: str) -> DataFrame:
    """The record that ``write_splits`` left below ``path``."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")


def split_manifest(df: DataFrame, label: str = "unified_label", split: str = "split") -> DataFrame:
    """Rows per split and class, and the class share of the whole in percent."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))
    # counts has one row per split and class, so an unpartitioned window is small
    of_class = F.sum("rows").over(Window.partitionBy(label))
    of_all = F.sum("rows").over(Window.partitionBy())
    return counts.select(split, label, "rows", F.round(of_class * 100.0 / of_all, 3).alias("class_pct_full"))


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON file; ``df`` is an aggregate of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append alerts as JSON files. Returns the running query."""
    w = (alerts.writeStream.format("json").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()
