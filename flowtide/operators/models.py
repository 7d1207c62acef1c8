"""Tier-1 and tier-3 learners on MLlib, scoring and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import binary_target, class_code, class_name, decide
from flowtide.operators.evaluate import confusion_matrix, overall_report, per_class_report
from flowtide.operators.features import assemble_features
from flowtide.operators.rounds import PATIENCE, best_round, cut_ensemble, joint_log_loss, pr_auc, score_counts, tree_arrays
from flowtide.session import cut

SEED = 42


def _prepared(df: DataFrame, label: str, target: Column) -> DataFrame:
    return assemble_features(df).select("features", target.cast("double").alias("y"),
                                        *(["is_val"] if "is_val" in df.columns else []))


def _fit(learner, data: DataFrame, hold: bool):
    """The fitted model; a learner reads its rows several times, held ones are derived once."""
    if not hold:
        return learner.fit(data)
    data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return learner.fit(data)
    finally:
        data.unpersist()


def train_binary(df: DataFrame, label: str = "unified_label", rounds: int = 300, depth: int = 6, rate: float = 0.1,
                 positive: str = S.DOS, seed: int = SEED, patience: int = PATIENCE, hold: bool = False):
    """Boosted trees for positive class against the rest.

    A boolean column ``is_val`` marks validation rows.  They are not trained on;
    the ensemble ends at the round with the largest area under their
    precision-recall curve before ``patience`` rounds without a larger one.
    ``hold`` keeps the prepared rows in the cache, spilling to disk, while they are fitted.
    """
    gbt = GBTClassifier(labelCol="y", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed)
    target = binary_target(label, positive)
    if "is_val" not in df.columns:
        return _fit(gbt, _prepared(df, label, target), hold)
    model = _fit(gbt, _prepared(df.where(~F.coalesce("is_val", F.lit(False))).drop("is_val"), label, target), hold)
    by_round = pr_auc_by_round(model, df.where("is_val"), label, positive)
    return cut_ensemble(model, best_round(by_round, patience)) if by_round else model


def pr_auc_by_round(model, df: DataFrame, label: str = "unified_label", positive: str = S.DOS) -> list[float]:
    """Area under the precision-recall curve of ``df`` after each round; empty without a positive row."""
    counts = score_counts(df, tree_arrays(model, df.sparkSession), binary_target(label, positive))
    return [r["pr_auc"] for r in pr_auc(counts).orderBy("round").collect()]  # one number per round


def train_multiclass(df: DataFrame, label: str = "unified_label", rounds: int = 400, depth: int = 8,
                     rate: float = 0.1, trees: int = 100, seed: int = SEED, learners: tuple = ("boosted", "forest"),
                     patience: int = PATIENCE, parallel: int = 2):
    """Two learners over the six classes: boosted trees one-vs-rest, and a random forest.

    With validation rows (``is_val``) the boosted ensembles of all classes end at
    the same round: the one with the least log loss before ``patience`` rounds
    without a lesser one.  Both learners train on the stored, prepared rows,
    ``parallel`` classes at a time.
    """
    val = df.where("is_val") if "is_val" in df.columns else None
    train = df if val is None else df.where(~F.coalesce("is_val", F.lit(False))).drop("is_val")
    data = cut(_prepared(train, label, class_code(label)))
    out = {}
    if "boosted" in learners:
        base = GBTClassifier(maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed)
        model = OneVsRest(classifier=base, labelCol="y", parallelism=parallel).fit(data)
        losses = [] if val is None else log_loss_by_round(model, val, label)
        if losses:
            end = best_round(losses, patience, largest=False)
            model = model._copyValues(OneVsRestModel([cut_ensemble(m, end) for m in model.models]))
        out["boosted"] = model
    if "forest" in learners:
        out["forest"] = RandomForestClassifier(labelCol="y", maxDepth=depth, numTrees=trees, seed=seed).fit(data)
    return out


def log_loss_by_round(model: OneVsRestModel, df: DataFrame, label: str = "unified_label") -> list[float]:
    """Mean log loss of ``df`` with all classes' ensembles cut after each round."""
    ensembles = [tree_arrays(m, df.sparkSession) for m in model.models]
    return [r["log_loss"] for r in joint_log_loss(df, ensembles, class_code(label)).orderBy("round").collect()]  # one number per round


def score_binary(model, df: DataFrame, out: str = "p1") -> DataFrame:
    """Probability of the positive class."""
    scored = model.transform(assemble_features(df))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def score_multiclass(model, df: DataFrame, out: str = "probs") -> DataFrame:
    """Class probabilities in code order, summing to 1.

    The binary models of a one-vs-rest learner are applied one after another,
    which works on streams as well.
    """
    scored, probs = class_probabilities(model, assemble_features(df))
    return scored.select(*df.columns, probs.alias(out))


def class_probabilities(model, scored: DataFrame, features: str = "features", where: Column | None = None) -> tuple[DataFrame, Column]:
    """The rows with the model's numbers and their total, and the class probabilities over these columns.

    Rows that fail ``where`` get null.  Every step of the model is read by one other, so
    the optimizer carries all of them into ``_p``: no model runs on rows that fail.  Steps
    per class stay in lambdas; written out, the code generated for a row gets longer
    than the JVM compiles.
    """
    if isinstance(model, OneVsRestModel):
        margins = []
        for i, m in enumerate(model.models):
            names = {m.rawPredictionCol: f"_raw{i}", m.probabilityCol: f"_prob{i}", m.predictionCol: f"_pred{i}", m.featuresCol: features}
            scored = m.copy(names).transform(scored)
            margins.append(vector_to_array(f"_raw{i}")[1])
        # the boosted logistic doubles the margin
        p, n = F.transform(F.array(*margins), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m))), len(margins)
    else:
        names = {model.rawPredictionCol: "_raw", model.probabilityCol: "_prob", model.predictionCol: "_pred", model.featuresCol: features}
        scored = model.copy(names).transform(scored)
        p, n = vector_to_array("_prob"), model.numClasses
    scored = scored.withColumn("_p", p if where is None else F.when(where, p))
    scored = scored.withColumn("_total", sum((F.get("_p", F.lit(i)) for i in range(n)), F.lit(0.0)))
    return scored, F.when(F.col("_total").isNotNull(), F.transform("_p", lambda x: x / F.col("_total")))


def predicted_label(probs: str = "probs") -> Column:
    return class_name(F.array_position(probs, F.array_max(probs)) - 1)


def binary_predictions(model, df: DataFrame, label: str = "unified_label", threshold: float = 0.5) -> DataFrame:
    """(y_true, y_pred) with the positive class against 'OTHER'."""
    names = F.when(decide("p1", threshold) == 1, S.DOS).otherwise("OTHER")
    truth = F.when(F.col(label) == S.DOS, S.DOS).otherwise("OTHER")
    return score_binary(model, df).select(truth.alias("y_true"), names.alias("y_pred"))


def multiclass_predictions(model, df: DataFrame, label: str = "unified_label") -> DataFrame:
    return score_multiclass(model, df).select(F.col(label).alias("y_true"), predicted_label().alias("y_pred"))


def area_under_pr(model, df: DataFrame, label: str = "unified_label") -> float:
    scored = model.transform(_prepared(df, label, binary_target(label)))
    return BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderPR").evaluate(scored)


def evaluate_predictions(pred: DataFrame, tag: str) -> DataFrame:
    """Long report (model, scope, label, metric, value) from one confusion matrix.

    The matrix is counted once; both reports read that small table.
    """
    cm = cut(confusion_matrix(pred))
    per = per_class_report(cm).select(
        F.lit("class").alias("scope"), "label",
        F.explode(F.create_map(*[x for c in ("precision", "recall", "f1", "support")
                                 for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    cols = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
    allr = overall_report(cm).select(
        F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("label"),
        F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return per.unionByName(allr).select(F.lit(tag).alias("model"), "scope", "label", "metric", "value")


def evaluate_model(model, df: DataFrame, tag: str, label: str = "unified_label", binary: bool = False) -> DataFrame:
    pred = binary_predictions(model, df, label) if binary else multiclass_predictions(model, df, label)
    return evaluate_predictions(pred, tag)


def stack_reports(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
