"""Flow tables: raw CSV folders, canonical columns, live captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.functions import micros, parse_timestamp

_LINE, _ROW = "_line", "_row"
# A field in quotes, with doubled or escaped quotes inside.
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'


def scan_flow_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Read every CSV of a folder (or the named files) with a declared schema.

    Rows with too many fields are dropped, short rows are kept and padded
    with nulls.  ``file_name`` tells where a row came from.

    Lines are read whole, because the parsed columns cannot tell a blank
    surplus field from none; fields are counted outside quotes.
    """
    raw = (
        spark.read.schema(T.StructType([T.StructField(_LINE, T.StringType(), True)]))
        .option("header", True).option("encoding", encoding).option("sep", "\u0001").option("quote", "")
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    bare = F.regexp_replace(_LINE, _QUOTED, "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    rows = raw.where(fields <= len(schema.fields)).select(
        F.from_csv(_LINE, schema.toDDL(), {"mode": "PERMISSIVE"}).alias(_ROW),
        F.col("_metadata.file_name").alias("file_name"))
    return rows.select(*[F.col(_ROW)[c].alias(c) for c in schema.names], "file_name")  # names may hold dots and slashes


def canonical_columns(df: DataFrame, short_layout: bool) -> DataFrame:
    """One column layout for both corpora: trimmed long names, no extra columns.

    Columns are taken by position, because the long header lists one feature
    twice and pads names with blanks.
    """
    drop = set(S.ONLY_IN_SHORT + S.IDENTIFIERS_IN_ONE_FILE) if short_layout else set()
    picked, seen = [], set()
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    for i, name in enumerate(df.columns):
        name = name.strip()
        # readers tell the two equal names apart by a number at the end
        if name.startswith(S.REPEATED_IN_LONG) and name[len(S.REPEATED_IN_LONG):].lstrip(".").isdigit():
            name = S.REPEATED_IN_LONG
        name = S.SHORT_TO_LONG.get(name, name) if short_layout else name
        if name in drop or name in seen:
            continue
        seen.add(name)
        picked.append(plain[f"c{i}"].alias(name))
    return plain.select(*picked)


def flows_with_source(df: DataFrame) -> DataFrame:
    """Short-layout rows with source and time, as the window operators take them.

    Times are day-first; rows whose time does not parse are dropped.
    """
    long = {S.SHORT_TO_LONG.get(c.strip(), c.strip()): c for c in df.columns}
    names = {"Src IP": "src_ip", "Timestamp": "ts", "Destination Port": "dst_port", "Protocol": "protocol",
             "Label": "raw_label", **dict(zip(S.GOLDEN12_LONG, S.GOLDEN12))}
    out = df.select(*[F.col(f"`{long[k]}`").alias(v) for k, v in names.items()])
    out = out.withColumns({"dst_port": F.col("dst_port").cast("int"), "protocol": F.col("protocol").cast("int")})
    return add_lineage(parse_timestamps(out, "ts"), 2018)


def add_lineage(df: DataFrame, year: int | None = None, origin: str | None = None) -> DataFrame:
    if year is not None:
        df = df.withColumn("source_year", F.lit(year).cast("int"))
    if origin is not None:
        df = df.withColumn("origin", F.lit(origin))
    return df


def to_engine_names(df: DataFrame) -> DataFrame:
    """Long feature names -> engine spelling."""
    return df.withColumnsRenamed(dict(zip(S.GOLDEN12_LONG, S.GOLDEN12)))


def to_long_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(S.GOLDEN12, S.GOLDEN12_LONG)))


def read_live_flows(spark: SparkSession, path: str, streaming: bool = False,
                    files_per_trigger: int = 1) -> DataFrame:
    """Live-capture CSV as a table, or replayed file by file as a stream."""
    if streaming:
        reader = spark.readStream.schema(S.LIVE_FLOW).option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = spark.read.schema(S.LIVE_FLOW)
    raw = reader.option("header", True).csv(path)
    return live_to_engine(raw)


def live_to_engine(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed(dict(zip(S.LIVE_FEATURES, S.GOLDEN12)))
    return named.withColumn("ts", F.try_to_timestamp("timestamp"))


def parse_timestamps(df: DataFrame, column: str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Parsed ``column``; rows whose text does not parse are dropped."""
    return df.withColumn(column, parse_timestamp(column, fmt)).where(F.col(column).isNotNull())


def unparsed_timestamps(df: DataFrame, column: str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    bad = parse_timestamp(column, fmt).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("rows_unparsed"))


def scale_time_units(df: DataFrame, factor: float = 1e6) -> DataFrame:
    """Time features of a live capture: seconds -> microseconds."""
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in S.TIME_COLUMNS})


def read_attack_log(spark: SparkSession, path: str) -> DataFrame:
    """Interval log with parsed start and end (UTC)."""
    raw = spark.read.schema(S.ATTACK_LOG).option("header", True).csv(path)
    return attack_log_times(raw)


def attack_log_times(raw: DataFrame) -> DataFrame:
    log = raw.select(
        F.try_to_timestamp("timestamp_start").alias("start_ts"),
        F.try_to_timestamp("timestamp_end").alias("end_ts"),
        "class_label", "src_ip", "dst_ip", "dst_port", "tool", "detail",
    )
    # an order-independent id that breaks ties between equal starts
    return log.withColumn("log_id", F.xxhash64(micros("start_ts"), micros("end_ts"), "class_label", "src_ip",
                                               "dst_ip", "dst_port", "tool", "detail"))
