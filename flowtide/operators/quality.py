"""Profiling and quality gates."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide import schema as S
from flowtide.functions import normalize_label
from flowtide.operators.labels import bounded_dimension


class SchemaMismatch(ValueError):
    """Two column sets that should agree do not."""


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")


def schema_guard(df: DataFrame, expected: list[str]) -> DataFrame:
    """Pass ``df`` through, or name the columns only one side has."""
    odd = sorted(set(df.columns) ^ set(expected))
    if odd:
        raise SchemaMismatch(f"columns on one side only: {odd}")
    return df


def profile_row_counts(df: DataFrame, file: str = "file_name") -> DataFrame:
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))


def profile_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows (less the header line) and size of every file of a folder.

    Rows are counted by one scan of lines; names and sizes come from the listing.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    counted = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    return _listing(spark, path, glob).join(counted, "path", "left").select(
        "file_name", F.greatest(F.coalesce("lines", F.lit(0)) - 1, F.lit(0)).alias("rows"),
        F.round(F.col("bytes") / 1048576, 2).alias("mb"), "bytes")


def profile_encoding(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Per file: lines, lines that are no valid UTF-8, and the reading to use."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("bad_lines"),
    ).withColumn("verdict", F.when(F.col("bad_lines") == 0, "utf-8").otherwise("latin1"))


def _listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, file_name and bytes of every file of a folder, and its partition columns.

    No content is read.  Spark lists no file of zero bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    parts = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    # names come URL-encoded, but for the plus sign
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return files.select(F.col("_metadata.file_path").alias("path"), name.alias("file_name"),
                        F.col("_metadata.file_size").alias("bytes"), *parts)


HEAD_BYTES = 65536


def first_record(read) -> list[str]:
    """Fields of the first CSV record; ``read(n)`` gives up to n further bytes, none at the end.

    A record ends at the first line end outside quotes, so a name may hold commas
    and line breaks.  Without any byte there is one empty name.
    """
    data, quoted, at = b"", False, 0
    while True:
        more = read(HEAD_BYTES)
        data += more
        for at in range(at, len(data)):
            if data[at] == 34:
                quoted = not quoted
            elif data[at] in (10, 13) and not quoted:
                break
        else:
            at = len(data)
            if more:
                continue
        line = data[:at].removeprefix(b"\xef\xbb\xbf")
        try:
            text = line.decode()
        except UnicodeDecodeError:
            text = line.decode("latin1")
        return next(csv.reader(io.StringIO(text, newline="")), None) or [""]


def _first_records(batches):
    from pyarrow import fs

    for batch in batches:
        columns = []
        for path in batch["path"]:
            files, at = fs.FileSystem.from_uri(path)
            with files.open_input_stream(at) as stream:
                columns.append(first_record(stream.read))
        yield batch.assign(columns=columns)


def file_headers(spark: SparkSession, path: str, glob: str = "*.csv", name: Column | None = None) -> DataFrame:
    """(file_name, columns): names in the first record of every file.

    Files are listed, spread over the tasks, and of each only the first block is
    read, so the work does not grow with the files' length.  ``name`` may group
    files that share one layout, by a partition folder say; the group's first
    file in path order speaks for it.
    """
    listed = _listing(spark, path, glob)
    listed = listed.select((F.col("file_name") if name is None else name.cast("string")).alias("file_name"), "path").repartition("path")
    heads = listed.mapInPandas(_first_records, "file_name string, path string, columns array<string>")
    return heads.groupBy("file_name").agg(F.min_by("columns", "path").alias("columns"))


def schema_consistency(headers: DataFrame) -> DataFrame:
    """Per file: names padded with blanks, and columns missing or extra against the first file.

    ``layouts`` is the number of distinct column lists over all files.
    """
    first = headers.agg(F.min_by("columns", "file_name")).scalar()
    layouts = headers.agg(F.count_distinct("columns")).scalar()

    def issues(cols, kind):
        return F.transform(cols, lambda c: F.struct(c.alias("column_name"), F.lit(kind).alias("issue")))

    padded = F.filter("columns", lambda c: c != F.trim(c))
    found = F.concat(
        issues(padded, "padded"),
        issues(F.array_except(F.col("_first"), F.col("columns")), "missing"),
        issues(F.array_except(F.col("columns"), F.col("_first")), "extra"),
    )
    return headers.withColumn("_first", first).select(
        "file_name", F.size("columns").alias("n_columns"), F.inline_outer(found).alias("column_name", "issue"),
        layouts.alias("layouts"))


def label_census(df: DataFrame, dim: DataFrame, file: str = "file_name", raw: str = "raw_label") -> DataFrame:
    """Per file and raw label: key, class (or DROP / UNMAPPED) and rows, most rows of a file first."""
    counts = df.groupBy(file, "source_year", raw).agg(F.count(F.lit(1)).alias("rows"))
    keyed = counts.withColumn("label_key", normalize_label(raw))
    joined = keyed.join(bounded_dimension(dim), ["source_year", "label_key"], "left")
    verdict = (F.when(F.col("label_key") == S.HEADER_KEY, "DROP")
               .otherwise(F.coalesce("unified_label", F.lit("UNMAPPED"))))
    census = joined.select(file, "source_year", raw, "label_key", verdict.alias("verdict"), "rows")
    return census.orderBy(file, "source_year", F.desc("rows"), raw)


def unmapped_labels(df: DataFrame, dim: DataFrame, raw: str = "raw_label") -> DataFrame:
    """Per year: unknown label keys with their rows; header rows are listed as DROP."""
    counts = df.groupBy("source_year", raw).agg(F.count(F.lit(1)).alias("rows"))
    keyed = counts.withColumn("label_key", normalize_label(raw))
    missing = keyed.join(bounded_dimension(dim), ["source_year", "label_key"], "left_anti")
    return missing.groupBy("source_year", "label_key").agg(F.sum("rows").alias("rows")).withColumn(
        "verdict", F.when(F.col("label_key") == S.HEADER_KEY, "DROP").otherwise("UNMAPPED"))


def nan_inf_profile(df: DataFrame, columns: list[str] | None = None, rates: list[str] | None = None) -> DataFrame:
    """Per feature: missing values and, for rate columns, infinities. One pass."""
    cols, rates = columns or S.GOLDEN12, S.RATE_COLUMNS if rates is None else rates
    inf = F.lit(float("inf"))
    aggs = []
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"n_{c}"))
        aggs.append((F.count_if(F.abs(c) == inf) if c in rates else F.lit(0).cast("bigint")).alias(f"i_{c}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("missing"),
                              F.col(f"i_{c}").alias("infinite")) for c in cols])
    return one.select(F.inline(rows))


def row_reconciliation(df: DataFrame, stages: dict) -> DataFrame:
    """Rows in, kept and dropped per stage from one scan.

    ``stages`` maps a stage name to the condition a row must meet to stay; a
    row reaches a stage only if it met all conditions before.
    """
    reach, aggs, out = F.lit(True), [], []
    for i, (name, cond) in enumerate(stages.items()):
        nxt = reach & F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(reach).alias(f"in{i}"), F.count_if(nxt).alias(f"kept{i}")]
        out.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"in{i}").alias("rows_in"),
                            F.col(f"kept{i}").alias("rows_kept"),
                            (F.col(f"in{i}") - F.col(f"kept{i}")).alias("rows_dropped")))
        reach = nxt
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def class_loss_check(before: DataFrame, after: DataFrame, label: str = "unified_label",
                     threshold: float = 0.02) -> DataFrame:
    """Per class of ``before``: rows lost, shares and a flag for loss above the threshold."""
    sides = before.groupBy(label).agg(F.count(F.lit(1)).alias("b")).withColumn("a", F.lit(0).cast("bigint"))
    sides = sides.unionByName(
        after.groupBy(label).agg(F.count(F.lit(1)).alias("a")).withColumn("b", F.lit(0).cast("bigint")))
    both = sides.groupBy(label).agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))
    return loss_table(both, label, threshold)


def loss_table(both: DataFrame, label: str = "unified_label", threshold: float = 0.02) -> DataFrame:
    """Loss columns over (class, rows_before, rows_after), one row per class."""
    every = Window.partitionBy()
    b, a = F.col("rows_before"), F.col("rows_after")
    lost = F.coalesce(F.try_divide(b - a, b), F.lit(0.0))
    return both.select(
        label, b, a, (b - a).alias("rows_dropped"),
        F.round(lost * 100, 4).alias("pct_of_class_lost"),
        F.round(F.coalesce(F.try_divide(a, F.sum(a).over(every)), F.lit(0.0)) * 100, 4).alias("pct_of_total_after"),
        F.round(F.try_divide(F.max(a).over(every), a), 1).alias("imbalance_ratio"),
        (lost > threshold).alias("flagged"),
    )


def split_balance_check(df: DataFrame, label: str = "unified_label", split: str = "split",
                        limit: float = 0.1) -> DataFrame:
    """Per class and split: share in percent, share in the whole, largest deviation, verdict."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(split)), 3)
    full = F.round(F.sum("n").over(Window.partitionBy(label)) * 100.0 / F.sum("n").over(every), 3)
    t = counts.select(split, label, share.alias("split_pct"), full.alias("full_pct"))
    worst = F.max(F.abs(F.col("split_pct") - F.col("full_pct"))).over(every)
    return t.withColumn("max_deviation", F.round(worst, 3)).withColumn("passed", F.col("max_deviation") < limit)


def negative_latency_check(latencies: DataFrame, column: str = "latency_ms") -> DataFrame:
    return latencies.agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col(column) < 0).alias("negative"))


def label_coverage_check(flows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Flows outside [first start, last end]; a flow without a time counts as outside."""
    lo = intervals.agg(F.min("start_ts")).scalar()
    hi = intervals.agg(F.max("end_ts")).scalar()
    inside = F.coalesce((F.col(ts) >= lo) & (F.col(ts) <= hi), F.lit(False))
    return flows.agg(F.count(F.lit(1)).alias("flows"), F.count_if(~inside).alias("outside"))
