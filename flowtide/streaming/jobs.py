"""Structured Streaming jobs. Row logic is shared with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators.cascade import alerts, cascade_decide, score_cascade
from flowtide.operators.windows import ATTACKS, MEANS, entropy_of_counts, label_from_counts
from flowtide import schema as S
from flowtide.plans.live import prepare_live
from flowtide.sources.events import filter_event_types, ids_event_features, ids_event_tuple
from flowtide.streaming.state import stream_blocks


def _timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_cascade(flows: DataFrame, tier1=None, tier3=None, seconds: bool = True) -> DataFrame:
    """Flow stream -> alerts. Without models the rows must carry scores ``p1`` and ``probs``."""
    ready = prepare_live(flows, seconds)
    decided = cascade_decide(ready) if tier1 is None else score_cascade(ready, tier1, tier3)
    return alerts(decided)


def stream_ids_events(events: DataFrame, tier1=None, tier3=None) -> DataFrame:
    """Event stream -> features -> alerts with the source to block."""
    rows = ids_event_tuple(ids_event_features(filter_event_types(events)))
    decided = cascade_decide(rows) if tier1 is None else score_cascade(rows, tier1, tier3)
    return alerts(decided)


def stream_metrics_live(decided: DataFrame, ts: str = "ts", width: str = "5 minutes",
                        delay: str = "10 minutes") -> DataFrame:
    """Counts per window while the stream runs."""
    return (_timed(decided, ts, delay).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("tier1_hit").alias("tier1_hits"),
        F.count("severity").alias("alerts"),
    ).select(F.col("w.start").alias("window_start"), "flows", "tier1_hits", "alerts"))


def stream_tier2_windows(flows: DataFrame, ts: str = "ts", width: str = "5 minutes", delay: str = "10 minutes",
                         label: str = "unified_label") -> DataFrame:
    """Streaming twin of ``tier2_windows``: a window is emitted once the watermark has passed it.

    Chained aggregates: counts per (window, source, port, protocol), then per
    port and per protocol, then the vector per (window, source).  State holds
    counts and sums, never flows.
    """
    fine = _timed(flows, ts, delay).groupBy(F.window(ts, width).alias("w"), "src_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in S.GOLDEN12],
        *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in ATTACKS])
    carried = ["n"] + [f"s_{c}" for c in S.GOLDEN12] + [f"n_{c}" for c in ATTACKS]
    at = F.window_time("w")
    copies = fine.select(
        at.alias("t"), "src_ip", *carried,
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_port"), F.col("dst_port").cast("int").alias("v")),
            F.struct(F.lit(False).alias("is_port"), F.col("protocol").cast("int").alias("v")))).alias("d"))
    port = F.col("d.is_port")
    per_value = copies.groupBy(F.window("t", width).alias("w"), "src_ip", port.alias("is_port"), F.col("d.v").alias("v")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(port, F.col(c))).alias(c) for c in carried[1:]])
    is_port = F.col("is_port")
    total = F.sum(F.when(is_port, F.col("n")))

    def entropy(side):
        return F.coalesce(entropy_of_counts(F.when(side & F.col("v").isNotNull(), F.col("n"))), F.lit(0.0))

    grouped = per_value.select("*", F.window_time("w").alias("t")).groupBy(F.window("t", width).alias("w2"), "src_ip").agg(
        total.alias("flow_count"), (F.sum("s_flow_duration") / total).alias("mean_flow_duration"),
        entropy(~is_port).alias("protocol_entropy"), entropy(is_port).alias("destination_port_entropy"),
        *[(F.sum(f"s_{c}") / total).alias(f"mean_{c}") for c in MEANS],
        F.count_if(is_port & F.col("v").isNotNull()).alias("unique_destination_ports"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in ATTACKS])
    attacks = sum((F.col(f"n_{c}") for c in ATTACKS[1:]), F.col(f"n_{ATTACKS[0]}"))
    return grouped.select(
        "src_ip", F.col("w2.start").alias("window_start"),
        *[c for c in grouped.columns if c not in ("w2", "src_ip") and c not in {f"n_{a}" for a in ATTACKS}],
        label_from_counts({c: F.col(f"n_{c}") for c in ATTACKS}).alias("window_label"),
        (attacks / F.col("flow_count")).alias("attack_flow_fraction"))


def stream_block_requests(alert_rows: DataFrame, ttl_seconds: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """Alert stream -> one ``block`` and one ``release`` action per hostile source; see ``stream_blocks``."""
    return stream_blocks(alert_rows, ttl_seconds, delay)


def stream_ids_blocks(events: DataFrame, tier1=None, tier3=None, ttl_seconds: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """Event stream -> features -> alerts -> block requests."""
    return stream_block_requests(stream_ids_events(events, tier1, tier3), ttl_seconds, delay)


def released(actions: DataFrame) -> DataFrame:
    """The finished blocks of stored actions, in the columns of the batch ``block_requests``."""
    return actions.where("action = 'release'").drop("action")


def run_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", name: str | None = None) -> None:
    """Drain an append stream into files and wait for it."""
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    q = (writer.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain an update-mode aggregate; every batch stores the rows it changed under its number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest state of every key of ``run_updates``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys + ["batch"]]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")
