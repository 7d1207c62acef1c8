"""Batch plan: raw flows -> cleaned, selected, balanced, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.balance import balance_dataset
from flowtide.operators.features import drop_incomplete, rates_inf_to_null, select_golden12
from flowtide.operators.labels import clean_labels
from flowtide.operators.quality import file_headers
from flowtide.operators.sampling import stratified_split
from flowtide.operators.setops import union_sources
from flowtide.sources.flows import add_lineage, canonical_columns, scan_flow_csv, to_engine_names


def read_raw_year(spark: SparkSession, path: str, year: int) -> list[DataFrame]:
    """One table per header layout found in a folder, read with that layout's own schema."""
    heads = file_headers(spark, path)
    layouts = heads.groupBy("columns").agg(F.collect_list("file_name").alias("files")).collect()  # one entry per file
    out = []
    for layout in sorted(layouts, key=lambda r: r["columns"]):
        names = []
        for c in layout["columns"]:
            names.append(c if c not in names else f"{c}.1")  # a header may repeat a name
        files = [f"{path.rstrip('/')}/{f}" for f in sorted(layout["files"])]
        out.append(scan_flow_csv(spark, files, S.long_layout(names), S.ENCODINGS[year]))
    return out


def merge_raw(spark: SparkSession, folders: dict[int, str], dim: DataFrame) -> DataFrame:
    """All raw files of all years in one column layout, labelled; unknown labels and header rows dropped."""
    parts = [add_lineage(canonical_columns(t, short_layout=year == 2018), year)
             for year, path in folders.items() for t in read_raw_year(spark, path, year)]
    return clean_labels(union_sources(*parts), dim, raw="Label").drop("label_key")


def select_merged(merged: DataFrame) -> DataFrame:
    """The twelve features of a merged table in engine spelling, incomplete rows dropped."""
    return drop_incomplete(rates_inf_to_null(select_golden12(to_engine_names(merged))))


def golden12(raw: DataFrame, dim: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Label, select and clean in one lazy pass: no shuffle, one broadcast of the label map."""
    labelled = clean_labels(raw, dim)
    return drop_incomplete(rates_inf_to_null(select_golden12(labelled, keep)))


RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def build_dataset(raw: DataFrame, dim: DataFrame, row_id: str, balance_first: bool = False, seed: int = 42, **balance):
    """Split rows ready for training; returns (rows with ``split``, balance report).

    By default only the training part is balanced, so that validation and
    test rows are all real.  ``balance_first`` balances before splitting.
    """
    clean = golden12(raw, dim, [row_id])
    cols = [row_id, *[c for c in clean.columns if c not in (row_id, "source_year")]]
    if balance_first:
        rows, report = balance_dataset(clean, row_id, seed=seed, **balance)
        return stratified_split(rows, "unified_label", row_id, RATIOS, seed), report
    split = stratified_split(clean.select(*cols), "unified_label", row_id, RATIOS, seed)
    train, report = balance_dataset(split.where("split = 'train'"), row_id, seed=seed, **balance)
    rest = split.where("split <> 'train'").withColumn("origin", F.lit("real"))
    return train.withColumn("split", F.lit("train")).unionByName(rest), report
