"""IDS event logs: one JSON object per line, blank and broken lines included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S

_BROKEN = "_broken"


def read_ids_events(spark: SparkSession, path: str, streaming: bool = False,
                    files_per_trigger: int = 1) -> DataFrame:
    if streaming:
        lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    else:
        lines = spark.read.text(path)
    return parse_ids_events(lines)


def parse_ids_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep lines that hold a JSON object; the rest is skipped."""
    return _parsed(lines, column).where(~F.col("_bad")).select(
        *[c for c in lines.columns if c != column], *[F.col(f"event.{c}") for c in S.IDS_EVENT.names])


def ids_line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """How many lines were blank, broken and good."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return _parsed(lines, column).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(blank).alias("blank_lines"),
        F.count_if(~blank & F.col("_bad")).alias("broken_lines"),
        F.count_if(~F.col("_bad")).alias("events"),
    )


def _parsed(lines: DataFrame, column: str) -> DataFrame:
    # PERMISSIVE parsing returns a struct of nulls for a broken line and keeps
    # its text in the extra field; blank lines and non-objects give null
    schema = T.StructType([*S.IDS_EVENT.fields, T.StructField(_BROKEN, T.StringType(), True)])
    event = F.from_json(column, schema, {"columnNameOfCorruptRecord": _BROKEN, "allowSingleQuotes": "false"})
    whole = F.endswith(F.rtrim(F.col(column)), F.lit("}"))
    bad = F.col("event").isNull() | F.col(f"event.{_BROKEN}").isNotNull() | ~F.coalesce(whole, F.lit(False))
    return lines.withColumn("event", event).withColumn("_bad", bad)


def filter_event_types(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(S.FLOW_EVENT_TYPES))


def ids_event_features(events: DataFrame) -> DataFrame:
    """The twelve features out of the counters of one event, absent ones defaulted."""
    def num(path, default):
        return F.coalesce(F.col(path), F.lit(default))

    d = events.withColumns({
        "_age": num("flow.age", 0.037),
        "_fp": num("flow.pkts_toserver", 1).cast("double"),
        "_bp": num("flow.pkts_toclient", 0).cast("double"),
        "_fb": num("flow.bytes_toserver", 64).cast("double"),
        "_bb": num("flow.bytes_toclient", 0).cast("double"),
    }).withColumn("_us", F.when(F.col("_age") > 0, F.col("_age") * 1e6).otherwise(1000.0))

    fp, bp, us = F.col("_fp"), F.col("_bp"), F.col("_us")
    one = F.lit(1.0)
    seconds = us / 1e6
    features = {
        "fwd_header_length": fp * 40.0,
        "bwd_header_length": bp * 40.0,
        "fwd_psh_flags": F.coalesce(F.col("tcp.psh"), F.lit(False)).cast("double"),
        "ack_flag_count": F.when(F.coalesce(F.col("tcp.ack"), F.lit(True)), fp).otherwise(0.0),
        "init_win_bytes_forward": num("tcp.window", 512).cast("double"),
        "flow_duration": us,
        "flow_packets_s": (fp + bp) / seconds,
        "flow_bytes_s": (F.col("_fb") + F.col("_bb")) / seconds,
        "fwd_packet_length_max": F.col("_fb") / F.greatest(one, fp),
        "flow_iat_mean": us / F.greatest(one, fp + bp),
        "fwd_iat_max": us / F.greatest(one, fp),
        "bwd_iat_min": F.when(bp > 0, us / F.greatest(one, bp)).otherwise(0.0),
    }
    return d.withColumns(features).drop("_age", "_fp", "_bp", "_fb", "_bb", "_us")


def ids_event_tuple(events: DataFrame) -> DataFrame:
    """The five-tuple, absent parts defaulted."""
    return events.withColumns({
        "src_ip": F.coalesce("src_ip", F.lit("0.0.0.0")),
        "src_port": F.coalesce("src_port", F.lit(0)),
        "dst_ip": F.coalesce("dest_ip", F.lit("0.0.0.0")),
        "dst_port": F.coalesce("dest_port", F.lit(0)),
        "proto": F.coalesce("proto", F.lit("TCP")),
    })
