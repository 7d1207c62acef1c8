"""Fitted cascades as versioned folders: both tiers with the class and feature order they were trained with.

A version is written as a whole and its manifest last, so a folder without one is
no version; a reader checks the orders against its own before it scores.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S

KINDS = {c.__name__: c for c in (GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel)}
MANIFEST = "version long, tier string, kind string, folder string, classes array<string>, features array<string>"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all finished versions."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/manifest/_SUCCESS"))
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json([f.getPath().getParent().toString() for f in found])


def save_cascade(spark: SparkSession, path: str, tier1, tier3, features: list[str] | None = None, classes: list[str] | None = None) -> int:
    """Store both tiers as the next version and return its number."""
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    folder, rows = f"{path}/version={number}", []
    for tier, model in (("tier1", tier1), ("tier3", tier3)):
        model.write().overwrite().save(f"{folder}/{tier}")  # what an attempt without manifest left is replaced
        rows.append((number, tier, type(model).__name__, tier, list(classes or S.CLASSES), list(features or S.GOLDEN12)))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{folder}/manifest")
    return number


def load_cascade(spark: SparkSession, path: str, version: int | None = None, features: list[str] | None = None, classes: list[str] | None = None):
    """(tier 1, tier 3) of a version, the latest by default; an error if its class or feature order is another."""
    known = versions(spark, path)
    if version is None:
        version = known.agg(F.max("version")).first()[0]
    rows = {r["tier"]: r for r in known.where(F.col("version") == version).collect()}
    if set(rows) != {"tier1", "tier3"}:
        raise FileNotFoundError(f"no finished version {version} below {path}")
    for r in rows.values():
        if list(r["classes"]) != list(classes or S.CLASSES):
            raise ValueError(f"version {version} was trained with the classes {r['classes']}")
        if list(r["features"]) != list(features or S.GOLDEN12):
            raise ValueError(f"version {version} was trained with the features {r['features']}")
    return tuple(KINDS[rows[t]["kind"]].load(f"{path}/version={version}/{rows[t]['folder']}") for t in ("tier1", "tier3"))
