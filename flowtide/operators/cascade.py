"""Two-tier decision: a fast binary score first, the full classifier for the rest."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import decide, predict_class, severity
from flowtide.operators.features import assemble_features
from flowtide.operators.models import class_probabilities

ALERT_COLUMNS = ["ts", "flow_id", "src_ip", "dst_ip", "dst_port", "severity", "predicted_class", "confidence",
                 "pipeline_tier"]


def _hit(p1: str, threshold: float) -> Column:
    return F.coalesce(decide(p1, threshold) == 1, F.lit(False))


def unscored(scored: DataFrame, p1: str = "p1", probs: str = "probs") -> DataFrame:
    """Rows in all, rows without a usable first score, rows with a probability that is no number."""
    gap = F.exists(probs, lambda x: x.isNull() | F.isnan(x))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(p1).isNull() | F.isnan(p1)).alias("p1_missing"),
        F.count_if(F.coalesce(gap, F.lit(True))).alias("probs_missing"))


def cascade_decide(scored: DataFrame, p1: str = "p1", probs: str = "probs", threshold: float = 0.5) -> DataFrame:
    """Add tier1_hit, predicted_class, confidence, pipeline_tier, severity to rows with both scores.

    A null or NaN score is no hit; without any number among ``probs`` the class is null and no alert follows.
    """
    hit = _hit(p1, threshold)
    best = predict_class(probs)
    d = scored.withColumns({"tier1_hit": hit, "_best": best})
    d = d.withColumns({
        "predicted_class": F.when(F.col("tier1_hit"), S.DOS).otherwise(F.col("_best.predicted_class")),
        "confidence": F.round(F.when(F.col("tier1_hit"), F.col(p1)).otherwise(F.col("_best.confidence")), 4),
        "pipeline_tier": F.when(F.col("tier1_hit"), S.TIER1).otherwise(S.TIER3),
    })
    return d.withColumn("severity", severity(F.col("tier1_hit"), F.col("predicted_class"))).drop("_best")


def score_cascade(df: DataFrame, tier1, tier3, threshold: float = 0.5) -> DataFrame:
    """Score with models; tier 3 sees only the rows tier 1 passes on.

    The input is read and scored by tier 1 once; tier 3 runs inside the condition
    that the row is no hit.  That condition is the only reader of ``_hit``: with a second
    one the optimizer would leave tier 3 in front of it, for every row.
    """
    first = tier1.transform(assemble_features(df)).select(*df.columns, "features", vector_to_array("probability")[1].alias("p1"))
    hit, empty = _hit("p1", threshold), F.array().cast("array<double>")
    rows, probs = class_probabilities(tier3, first.withColumn("_hit", hit), where=~F.col("_hit"))
    scored = rows.select(*df.columns, "p1", F.when(hit, empty).otherwise(probs).alias("probs"))
    return cascade_decide(scored, threshold=threshold)


def alerts(decided: DataFrame) -> DataFrame:
    """Alert records; a benign verdict gives none."""
    return decided.where(F.col("severity").isNotNull()).select(*[c for c in ALERT_COLUMNS if c in decided.columns])


def stream_metrics(decided: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """Totals, tier shares and alerts; latency and throughput when the elapsed time is known."""
    n = F.count(F.lit(1))
    hits = F.count_if("tier1_hit")
    m = decided.agg(
        n.alias("total_flows"), hits.alias("tier1_hits"), F.round(hits * 100.0 / n, 4).alias("tier1_pct"),
        (n - hits).alias("tier3_evaluations"), F.round((n - hits) * 100.0 / n, 4).alias("tier3_pct"),
        F.count("severity").alias("alerts"))
    if elapsed_sec is None:
        return m
    return m.withColumns({
        "avg_latency_us": F.round(F.lit(elapsed_sec) * 1e6 / F.col("total_flows"), 2),
        "throughput_fps": F.round(F.col("total_flows") / F.lit(elapsed_sec), 2),
    })


def realtime_table(metrics: DataFrame) -> DataFrame:
    """The report row: flows, offload and escalation share, latency, throughput."""
    extra = [c for c in ("avg_latency_us", "throughput_fps") if c in metrics.columns]
    return metrics.select(
        "total_flows", F.round("tier1_pct", 2).alias("offload_pct"), F.col("tier1_hits").alias("offload_flows"),
        F.round("tier3_pct", 2).alias("escalation_pct"), F.col("tier3_evaluations").alias("escalation_flows"), *extra)


def block_requests(alert_rows: DataFrame) -> DataFrame:
    """One request per hostile source: first and last alert, number, class of the first alert."""
    at = F.struct("ts", "flow_id")
    return alert_rows.groupBy("src_ip").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_alerts"),
        F.min_by("predicted_class", at).alias("predicted_class"))
