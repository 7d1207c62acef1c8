"""Class tables, confusion matrices, metric reports, latency summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide import schema as S
from flowtide.operators.quantiles import exact_quantiles


def class_counts(df: DataFrame, label: str = "unified_label", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("rows"))


def count_order(df: DataFrame, column: str) -> DataFrame:
    """Values by falling count, then by name."""
    return class_counts(df, column).orderBy(F.desc("rows"), column)


def class_shares(df: DataFrame, label: str = "unified_label") -> DataFrame:
    counts = class_counts(df, label)
    total = F.sum("rows").over(Window.partitionBy())  # one row per class
    return counts.withColumn("pct", F.round(F.col("rows") * 100.0 / total, 3))


def worst_imbalance(df: DataFrame, label: str = "unified_label") -> DataFrame:
    counts = class_counts(df, label)
    big, small = F.max("rows"), F.min("rows")
    return counts.agg(
        big.alias("majority_rows"), F.min_by(label, F.struct("rows", label)).alias("smallest_class"),
        small.alias("smallest_rows"), F.round(big / small, 1).alias("ratio"))


# --- classification metrics -------------------------------------------------

def confusion_matrix(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: list[str] | None = None,
                     labels: list[str] | None = None) -> DataFrame:
    """Rows per (true, predicted) pair with empty cells filled.

    Classes are the union of both columns unless given; null is a class of its
    own, so no row is lost.  Given labels keep only their own cells.  After the first
    aggregate there are at most classes x classes rows per configuration.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("t", "p"), F.col("n")))).alias("m"),
        F.array_sort(F.array_union(F.collect_set(F.struct(F.col("t").alias("c"))),
                                   F.collect_set(F.struct(F.col("p").alias("c"))))).alias("found"))
    names = F.array(*[F.lit(x) for x in labels]) if labels else F.col("found.c")
    grid = whole.select(*by, "m", names.alias("k")).select(*by, "m", "k", F.explode("k").alias(true))
    grid = grid.select(*by, "m", true, F.explode("k").alias(pred))
    key = F.struct(F.col(true).alias("t"), F.col(pred).alias("p"))
    return grid.select(*by, true, pred, F.coalesce(F.try_element_at("m", key), F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class_report(cm: DataFrame, true: str = "y_true", pred: str = "y_pred", by: list[str] | None = None,
                     digits: int | None = 6) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    by = by or []
    side = F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("as_true")),
                             F.struct(F.col(pred).alias("label"), F.lit(0).alias("as_true"))))
    marks = cm.select(*by, "n", F.col(true).eqNullSafe(F.col(pred)).alias("hit"), side.alias("s"))
    sums = marks.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("hit") & (F.col("s.as_true") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.as_true") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.as_true") == 0, F.col("n")).otherwise(0)).alias("guessed"))
    p, r = _ratio(F.col("tp"), F.col("guessed")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("guessed") + F.col("support"))

    def rnd(c):
        return c if digits is None else F.round(c, digits)

    return sums.select(*by, "label", rnd(p).alias("precision"), rnd(r).alias("recall"), rnd(f1).alias("f1"), "support")


def overall_report(cm: DataFrame, true: str = "y_true", pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision / recall / F1, weighted F1 per configuration."""
    by = by or []
    classes = per_class_report(cm, true, pred, by, digits=None)
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        F.round(F.sum(F.col("recall") * F.col("support")) / total, 6).alias("accuracy"),
        F.round(F.avg("precision"), 6).alias("macro_precision"),
        F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / total, 6).alias("weighted_f1"),
        total.alias("n_rows"))


def compare_models(metrics: DataFrame, model: str = "model", metric: str = "macro_f1") -> DataFrame:
    """Metric rows with the winner marked: highest ``metric``, first name on a tie."""
    first = F.row_number().over(Window.orderBy(F.desc(metric), model))  # one row per model
    return metrics.withColumn("winner", first == 1)


def compare_learners(scored: DataFrame, model: str = "model") -> DataFrame:
    """Scored rows of several learners -> overall report of each, winner marked."""
    return compare_models(overall_report(confusion_matrix(scored, by=[model]), by=[model]), model)


def performance_table(scored: DataFrame, config: str = "config", baseline: str = "baseline",
                      positive: str = S.DOS) -> DataFrame:
    """One row per configuration: accuracy, precision / recall / F1 of the positive class, change to the baseline."""
    t, p = F.col("y_true") == positive, F.col("y_pred") == positive
    m = scored.groupBy(config).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"),
        F.count_if(t & p).alias("tp"), F.count_if(p).alias("guessed"), F.count_if(t).alias("support"))
    acc = F.col("right") * 100.0 / F.col("n_rows")
    base = F.max(F.when(F.col(config) == baseline, acc)).over(Window.partitionBy())  # one row per configuration
    return m.select(
        config, "n_rows", F.round(acc, 2).alias("accuracy_pct"),
        F.round(_ratio(F.col("tp"), F.col("guessed")), 4).alias("dos_precision"),
        F.round(_ratio(F.col("tp"), F.col("support")), 4).alias("dos_recall"),
        F.round(_ratio(2.0 * F.col("tp"), F.col("guessed") + F.col("support")), 4).alias("dos_f1"),
        F.round(acc - base, 2).alias("accuracy_delta"))


# --- latencies --------------------------------------------------------------

PROBS = [0.5, 0.95, 0.99]


def _named(q: DataFrame, keep: list[str], columns: list[str], digits: int) -> DataFrame:
    out = {"mean": F.col("mean"), "median": F.col("q")[0], "min": F.col("min"), "p95": F.col("q")[1],
           "p99": F.col("q")[2], "max": F.col("max"), "std": F.col("std")}
    return q.select(*keep, *[F.round(out[c], digits).alias(c) for c in columns])


def latency_summary(df: DataFrame, stages: list[str], tier: str = "tier", approximate: bool = False,
                    digits: int = 9) -> DataFrame:
    """Per tier and stage: mean, median, p95, p99, max."""
    long = df.unpivot([tier], stages, "stage", "ms")
    keep, cols = [tier, "stage"], ["mean", "median", "p95", "p99", "max"]
    if approximate:
        q = long.groupBy(*keep).agg(F.avg("ms").alias("mean"), F.max("ms").alias("max"), F.min("ms").alias("min"),
                                    F.stddev_samp("ms").alias("std"), F.percentile_approx("ms", PROBS).alias("q"))
    else:
        q = exact_quantiles(long, keep, "ms", PROBS)
    return _named(q, keep, cols, digits)


def latency_stats(df: DataFrame, column: str = "latency_ms", digits: int = 9) -> DataFrame:
    """Mean, median, min, p95, p99, max and sample deviation of all rows."""
    q = exact_quantiles(df, [], column, PROBS)
    return _named(q, ["n"], ["mean", "median", "min", "p95", "p99", "max", "std"], digits)


def latency_target(summary: DataFrame, target_ms: float, stage: str = "total_ms") -> DataFrame:
    """Whether mean and p95 of the total stay below the target."""
    return summary.where(F.col("stage") == stage).select(
        "tier", "mean", "p95", F.lit(target_ms).alias("target_ms"),
        (F.col("mean") < target_ms).alias("mean_ok"), (F.col("p95") < target_ms).alias("p95_ok"))


# --- attributions -----------------------------------------------------------

def mean_abs_attribution(phi: DataFrame, by: list[str] | None = None) -> DataFrame:
    return phi.groupBy(*(by or []), "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def attribution_shift(baseline: DataFrame, adapted: DataFrame) -> DataFrame:
    """Mean absolute attribution of two models per feature and the change, largest adapted first."""
    # one row per feature on both sides
    a = mean_abs_attribution(baseline).withColumnRenamed("mean_abs", "baseline_mean_abs")
    b = mean_abs_attribution(adapted).withColumnRenamed("mean_abs", "adapted_mean_abs")
    return (a.join(b, "feature")
            .withColumn("shift_delta", F.col("adapted_mean_abs") - F.col("baseline_mean_abs"))
            .orderBy(F.desc("adapted_mean_abs"), "feature"))


def top_features(shift: DataFrame, k: int = 8) -> DataFrame:
    return shift.orderBy(F.desc("adapted_mean_abs"), "feature").limit(k)


def primary_driver(shift: DataFrame) -> DataFrame:
    """The feature with the largest mean absolute attribution of each model."""
    parts = [shift.select(F.lit(m).alias("model"), "feature", F.col(c).alias("v"))
             for m, c in (("baseline", "baseline_mean_abs"), ("adapted", "adapted_mean_abs"))]
    return reduce(DataFrame.unionAll, parts).groupBy("model").agg(F.max_by("feature", F.struct("v", "feature")).alias("feature"))
