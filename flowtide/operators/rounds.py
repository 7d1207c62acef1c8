"""Choosing the number of boosting rounds by validation rows.

The trees of a fitted ensemble score every validation row once; running sums give
the margin after each round.  A task turns them into counts per (round, score
bin), so only sums are shuffled, however many validation rows there are.  The
best round follows the patience rule and the ensemble is cut there; rounds past
it cost training time but never change the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide import schema as S
from flowtide.session import scratch_path

SCORE_BINS = 1 << 20  # bins of the score between 0 and 1; a round has no more counts than these
PATIENCE = 20


def tree_arrays(model, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, value) per round, from the saved form of the model.

    Feature -1 marks a leaf; values carry the round's weight.  A fitted model is
    local to the driver anyway.
    """
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas()
    out = []
    for tree, rows in nodes.groupby("treeID"):
        rows = rows.sort_values("id")
        leaf = rows["leftChild"].to_numpy() < 0
        out.append((np.where(leaf, -1, rows["feature"].to_numpy()), rows["threshold"].fillna(0.0).to_numpy(dtype=float), rows["leftChild"].to_numpy(),
                    rows["rightChild"].to_numpy(), rows["prediction"].to_numpy(dtype=float) * model.treeWeights[tree]))
    return out


def margins_by_round(x: np.ndarray, trees) -> Iterator[np.ndarray]:
    """The margin of every row after each round."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            live = np.flatnonzero(feature[at] >= 0)
            if not len(live):
                break
            node = at[live]
            at[live] = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
        total = total + value[at]
        yield total


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -300, 300)))  # the boosted logistic doubles the margin


def score_counts(df: DataFrame, trees, target, features: list[str] | None = None) -> DataFrame:
    """(round, bin, positives, rows) of the scores after every round."""
    cols = features or S.GOLDEN12
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b["y"].to_numpy(dtype=bool)
            for i, margin in enumerate(margins_by_round(b[cols].to_numpy(dtype=float), shared.value)):
                at, where = np.unique(np.minimum((_probability(margin) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1), return_inverse=True)
                yield pd.DataFrame({"round": i + 1, "bin": at, "positives": np.bincount(where[y], minlength=len(at)), "rows": np.bincount(where, minlength=len(at))})

    parts = df.select(*cols, target.cast("boolean").alias("y")).mapInPandas(run, "round int, bin long, positives long, rows long")
    return parts.groupBy("round", "bin").agg(F.sum("positives").alias("positives"), F.sum("rows").alias("rows"))


def pr_auc(counts: DataFrame) -> DataFrame:
    """(round, pr_auc): area under the precision-recall curve by trapezoids, from recall 0 at the first precision."""
    down = Window.partitionBy("round").orderBy(F.col("bin").desc())
    c = counts.withColumns({"tp": F.sum("positives").over(down), "n": F.sum("rows").over(down), "all": F.sum("positives").over(Window.partitionBy("round"))})
    c = c.where("all > 0").withColumns({"p": F.col("tp") / F.col("n"), "r": F.col("tp") / F.col("all")})
    area = (F.col("r") - F.coalesce(F.lag("r").over(down), F.lit(0.0))) * (F.col("p") + F.coalesce(F.lag("p").over(down), F.col("p"))) / 2
    return c.withColumn("area", area).groupBy("round").agg(F.sum("area").alias("pr_auc"))


def joint_log_loss(df: DataFrame, ensembles, code, features: list[str] | None = None) -> DataFrame:
    """(round, log_loss) of one-vs-rest ensembles whose shares are normalised to sum 1, all cut at the same round."""
    cols = features or S.GOLDEN12
    shared = df.sparkSession.sparkContext.broadcast(ensembles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = b[cols].to_numpy(dtype=float), b["y"].to_numpy(dtype=int)
            walks, last, i = [margins_by_round(x, t) for t in shared.value], [np.zeros(len(x))] * len(shared.value), 0
            for i in range(max(len(t) for t in shared.value)):
                last = [next(w, m) for w, m in zip(walks, last)]
                p = np.stack([_probability(m) for m in last], axis=1)
                own = np.clip(p[np.arange(len(y)), y] / p.sum(axis=1), 1e-15, 1.0)
                yield pd.DataFrame({"round": [i + 1], "loss": [float(-np.log(own).sum())], "rows": [len(y)]})

    parts = df.select(*cols, code.cast("int").alias("y")).where("y IS NOT NULL").mapInPandas(run, "round int, loss double, rows long")
    return parts.groupBy("round").agg((F.sum("loss") / F.sum("rows")).alias("log_loss"))


def best_round(values: list[float], patience: int = PATIENCE, largest: bool = True) -> int:
    """The round (from 1) that training with patience would keep: the first best before ``patience`` rounds without a better one."""
    best, at = None, 0
    for i, v in enumerate(values, start=1):
        if best is None or (v > best if largest else v < best):
            best, at = v, i
        elif i - at >= patience:
            break
    return at


def cut_ensemble(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The first ``rounds`` trees as a model with the same settings."""
    if rounds >= len(model.trees):
        return model
    java, sc = model._java_obj, SparkSession.active().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    held = java.trees()
    for i in range(rounds):
        trees[i], weights[i] = held[i], float(model.treeWeights[i])
    short = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{rounds}", trees, weights, java.numFeatures(), 2)
    out = GBTClassificationModel(java.copyValues(short, java.extractParamMap()))
    out._resetUid(out._java_obj.uid())
    out._transfer_params_from_java()
    return out
