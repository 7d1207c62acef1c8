import itertools
import re
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.catalog import queries
from flowtide.operators import artefact, attribution, cascade, features, models, rounds
from flowtide.operators.evaluate import attribution_shift
from flowtide.plans import live
from flowtide.session import scratch_path
from flowtide.streaming import jobs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x = rng.lognormal(0, 1, (n, 12))
    label = np.where(x[:, 6] * x[:, 7] > 2, "DoS_DDoS", np.where(x[:, 0] > 1.5, "BRUTE_FORCE", np.where(x[:, 2] > 2, "WEB_ATTACK", "BENIGN")))
    df = spark.createDataFrame([(i, *map(float, x[i]), str(label[i]), i % 5 == 0) for i in range(n)],
                               "flow_id long, " + ", ".join(f"{c} double" for c in S.GOLDEN12) + ", unified_label string, is_val boolean")
    return df.repartition(4, "flow_id").cache()


@pytest.fixture(scope="module")
def tier1(data):
    return models.train_binary(data, rounds=8, depth=4)


@pytest.fixture(scope="module")
def tier3(data):
    return models.train_multiclass(data, rounds=4, depth=4, trees=10)


def value(report, tag, metric, label=None):
    r = report.where((F.col("model") == tag) & (F.col("metric") == metric))
    r = r.where(F.col("label").isNull()) if label is None else r.where(F.col("label") == label)
    return r.first()["value"]


def test_binary_learner(data, tier1):
    rep = models.evaluate_model(tier1, data, "t1", binary=True)
    assert value(rep, "t1", "accuracy") > .93 and value(rep, "t1", "recall", "DoS_DDoS") > .9
    assert models.area_under_pr(tier1, data) > .95


def test_multiclass_learners(data, tier3):
    for name, m in tier3.items():
        p = models.score_multiclass(m, data).select(F.size("probs").alias("k"), F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert p.where("k <> 6 or abs(s - 1) > 1e-9").count() == 0
        assert value(models.evaluate_model(m, data, name), name, "accuracy") > .7


def test_cascade_scores_every_row_once(data, tier1, tier3):
    out = cascade.score_cascade(data, tier1, tier3["boosted"])
    assert out.count() == data.count() == out.select("flow_id").distinct().count()
    assert out.where("tier1_hit and size(probs) > 0").count() == 0
    assert out.where("not tier1_hit and size(probs) <> 6").count() == 0
    assert out.where("tier1_hit and predicted_class <> 'DoS_DDoS'").count() == 0


@pytest.mark.parametrize("learner", ["boosted", "forest"])
def test_cascade_reads_its_input_once(spark, data, tier1, tier3, learner):
    """One pass over the rows, tier 3 under the condition that tier 1 passed the row on, the scores of the models alone."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    out = cascade.score_cascade(data.withColumn("flow_duration", noted("flow_duration")), tier1, tier3[learner])
    rows = {r["flow_id"]: r for r in out.collect()}
    assert seen.value == data.count() == len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _raw" not in plan and "AS _prob" not in plan  # models of tier 3 are no columns of their own
    p1 = {r["flow_id"]: r["p1"] for r in models.score_binary(tier1, data).collect()}
    probs = {r["flow_id"]: r["probs"] for r in models.score_multiclass(tier3[learner], data).collect()}
    assert all(r["p1"] == p1[i] and r["probs"] == ([] if p1[i] > .5 else probs[i]) for i, r in rows.items())
    assert 0 < sum(r["tier1_hit"] for r in rows.values()) < len(rows)


def test_binary_learner_reads_its_rows_once(spark, data):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    rows = data.drop("is_val").withColumn("flow_duration", noted("flow_duration"))
    model = models.train_binary(rows, rounds=2, depth=3, hold=True)
    assert seen.value == data.count()
    assert model.toDebugString.split("\n", 1)[1] == models.train_binary(data.drop("is_val"), rounds=2, depth=3).toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("learner", ["boosted", "forest"])
def test_class_probabilities_under_a_condition(data, tier1, tier3, learner):
    """Rows that fail have none, the others theirs; the code of a cascade's row stays short enough to be compiled."""
    rows, probs = models.class_probabilities(tier3[learner], features.assemble_features(data), where=F.col("flow_id") % 3 == 0)
    got = {r["flow_id"]: r["probs"] for r in rows.select("flow_id", probs.alias("probs")).collect()}
    want = {r["flow_id"]: r["probs"] for r in models.score_multiclass(tier3[learner], data).collect()}
    assert got == {i: p if i % 3 == 0 else None for i, p in want.items()}
    out = cascade.score_cascade(data, tier1, tier3[learner])
    mode = data.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out._jdf.queryExecution().explainString(mode))]
    assert all(x < 8000 for x in sizes)


def test_attributions_sum_to_margin(spark, data, tier1):
    leaves = attribution.model_leaves(tier1, spark)
    phi = attribution.feature_attribution(tier1, data, leaves=leaves)
    assert phi.count() == data.count() * 12
    sums = phi.groupBy("flow_id").agg(F.sum("phi").alias("s"))
    margin = tier1.transform(features.assemble_features(data)).select("flow_id", vector_to_array("rawPrediction")[1].alias("m"))
    worst = sums.join(margin, "flow_id").agg(F.max(F.abs(F.col("s") + attribution.attribution_bias(leaves) - F.col("m")))).first()[0]
    assert worst < 1e-9


def test_leaf_values_are_shapley_values():
    """Closed form against the definition: average marginal gain over all orders."""
    rng = np.random.default_rng(2)
    for m in (1, 2, 4, 5):
        r, v = rng.random(m), 1.7
        table = attribution.leaf_values(v, np.array([[(code >> i) & 1 for i in range(m)] for code in range(1 << m)], dtype=float), r)
        for code in range(1 << m):
            o = np.array([(code >> i) & 1 for i in range(m)], dtype=float)

            def game(s):
                return v * np.prod([o[i] if i in s else r[i] for i in range(m)])

            for i in range(m):
                want = sum(game(set(p[:p.index(i)]) | {i}) - game(set(p[:p.index(i)])) for p in itertools.permutations(range(m))) / factorial(m)
                assert np.isclose(table[code, i], want)


def test_adaptation_learns_the_live_domain(spark, data):
    """The live side has moved: old models fail on it, adapted ones do not."""
    moved = data.withColumns({c: F.col(c) * 100 for c in S.GOLDEN12}).withColumnRenamed("unified_label", "ground_truth_label")
    history = data.drop("is_val")
    old = models.train_binary(history, rounds=5, depth=4)
    before = models.evaluate_model(old, moved, "old", "ground_truth_label", binary=True)
    t1, t3, after = live.domain_adapt(history, moved, rounds=5, depth=4)
    assert value(after, "tier1_adapted", "accuracy") > value(before, "old", "accuracy") + .1
    held = sum(r["value"] for r in after.where("model = 'tier3_adapted' and metric = 'support'").collect())
    assert held == 1050  # 70 % of the live rows


def test_registered_adaptation_trains_in_full(data, monkeypatch):
    """The query trains the operator's 100 rounds of depth 6, both tiers on all of the history and 30 % of the live rows."""
    seen = {}

    def watched(name):
        fit = getattr(live, name)

        def run(df, label, rounds, depth, **rest):
            seen[name] = rounds, depth, df.count(), df.rdd.getNumPartitions()
            return fit(df, label, 1, 1, **rest)

        monkeypatch.setattr(live, name, run)

    watched("train_binary")
    watched("train_multiclass")
    history = data.withColumn("split", F.when(F.col("is_val"), "val").otherwise("train"))
    monkeypatch.setattr(queries, "_data", lambda spark, sf: history.drop("is_val"))
    monkeypatch.setattr(queries, "_live", lambda spark, sf: data.drop("is_val").withColumnRenamed("unified_label", "ground_truth_label"))
    report = queries.QUERIES["domain_adapt"](data.sparkSession, "unread")
    assert seen == {n: (100, 6, 1200 + 450, 1) for n in ("train_binary", "train_multiclass")}  # a small table in one task
    held = sum(r["value"] for r in report.where("model = 'tier3_adapted' and metric = 'support'").collect())
    assert held == 1050


def test_classes_trained_at_a_time_change_no_model(data):
    one, all_ = (models.train_multiclass(data.drop("is_val").coalesce(1), rounds=2, depth=3, learners=("boosted",), parallel=n)["boosted"] for n in (1, 6))
    assert [m.toDebugString.split("\n", 1)[1] for m in one.models] == [m.toDebugString.split("\n", 1)[1] for m in all_.models]


def test_missing_feature_is_an_error_at_the_model_edge(spark, data, tier1):
    broken = data.withColumn("flow_duration", F.lit(None).cast("double"))
    with pytest.raises(Exception):
        models.score_binary(tier1, broken).collect()


def pr_area(y, score):
    """Area under the precision-recall curve by trapezoids over distinct scores."""
    order = np.argsort(-score, kind="stable")
    y, score = y[order], score[order]
    ends = np.flatnonzero(np.append(score[1:] != score[:-1], True))
    tp, n = np.cumsum(y)[ends], ends + 1
    p, r = tp / n, tp / y.sum()
    return float((np.diff(np.append(0, r)) * (p + np.append(p[0], p[:-1])) / 2).sum())


def test_rounds_are_chosen_as_by_refitting(data):
    """Every number of rounds fitted anew: the same areas, the same choice, the same model."""
    train, val = data.where("not is_val").drop("is_val"), data.where("is_val")
    y = np.array([r.unified_label == S.DOS for r in val.orderBy("flow_id").select("unified_label").collect()])
    areas, kept = [], {}
    for n in range(1, 7):
        m = models.train_binary(train, rounds=n, depth=2)
        kept[n] = np.array([r.p1 for r in models.score_binary(m, val).orderBy("flow_id").select("p1").collect()])
        areas.append(pr_area(y, kept[n]))
    assert np.allclose(models.pr_auc_by_round(m, val), areas, atol=1e-6)
    for patience in (1, 3):
        chosen = models.train_binary(data, rounds=6, depth=2, patience=patience)
        best = rounds.best_round(areas, patience)
        assert chosen.getNumTrees == best
        got = np.array([r.p1 for r in models.score_binary(chosen, val).orderBy("flow_id").select("p1").collect()])
        assert np.allclose(got, kept[best])


def test_patience():
    assert rounds.best_round([1, 2, 2, 1, 3], patience=2) == 2
    assert rounds.best_round([1, 2, 2, 1, 3], patience=3) == 5
    assert rounds.best_round([3, 2, 2.5, 1], patience=9, largest=False) == 4
    assert rounds.best_round([]) == 0


def test_joint_stopping_of_the_classes(data):
    full = models.train_multiclass(data.drop("is_val"), rounds=4, depth=3, learners=("boosted",))["boosted"]
    losses = models.log_loss_by_round(full, data)
    code = {c: i for i, c in enumerate(S.CLASSES)}
    rows = models.score_multiclass(full, data).select("unified_label", "probs").collect()
    assert losses[-1] == pytest.approx(-np.mean([np.log(max(r.probs[code[r.unified_label]], 1e-15)) for r in rows]))
    kept = models.train_multiclass(data, rounds=4, depth=3, learners=("boosted",), patience=1)["boosted"]
    by_round = models.log_loss_by_round(models.train_multiclass(data.where("not is_val").drop("is_val"), rounds=4, depth=3, learners=("boosted",))["boosted"], data.where("is_val"))
    assert {m.getNumTrees for m in kept.models} == {rounds.best_round(by_round, 1, largest=False)}


@pytest.mark.parametrize("learner", ["boosted", "forest"])
def test_a_stored_cascade_serves_a_stream(spark, data, tier1, tier3, learner):
    """Saved, loaded and applied to a stream of several batches: the alerts of the batch."""
    path = scratch_path(spark, "cascade")
    assert artefact.save_cascade(spark, path, tier1, tier3[learner]) == 1
    t1, t3 = artefact.load_cascade(spark, path)
    flows = data.select("*", F.timestamp_seconds("flow_id").alias("ts"), F.concat(F.lit("s"), F.col("flow_id") % 3).alias("src_ip"),
                        F.lit("d").alias("dst_ip"), F.lit(80).alias("dst_port")).drop("is_val", "unified_label")
    folder = scratch_path(spark, "flows")
    flows.repartition(3).write.parquet(folder)
    stream = jobs.stream_cascade(spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(folder), t1, t3, seconds=False)
    out = scratch_path(spark, "out")
    jobs.run_to_files(stream, out, scratch_path(spark, "ckpt"))
    want = cascade.alerts(cascade.score_cascade(flows, tier1, tier3[learner]))
    got = spark.read.schema(stream.schema).parquet(out).select(want.columns)
    assert got.count() == want.count() > 100 and got.exceptAll(want).isEmpty()


def test_cascade_versions_and_orders_are_checked(spark, tier1, tier3):
    path = scratch_path(spark, "cascade")
    with pytest.raises(FileNotFoundError):
        artefact.load_cascade(spark, path)
    assert artefact.save_cascade(spark, path, tier1, tier3["forest"]) == 1
    tier1.write().save(f"{path}/version=2/tier1")  # an attempt that broke off
    assert artefact.versions(spark, path).select("version").distinct().count() == 1
    assert artefact.save_cascade(spark, path, tier1, tier3["forest"], classes=S.CLASSES[::-1]) == 2
    with pytest.raises(ValueError):
        artefact.load_cascade(spark, path)
    assert len(artefact.load_cascade(spark, path, version=1)) == 2
    with pytest.raises(FileNotFoundError):
        artefact.load_cascade(spark, path, version=7)


def test_attributions_of_every_class_and_of_a_deep_model(spark, data, tier3):
    rows = data.limit(150).cache()
    phi = attribution.feature_attribution(tier3["boosted"], rows)
    assert phi.count() == 150 * 6 * 12
    for code, (name, m) in enumerate(zip(S.CLASSES, tier3["boosted"].models)):
        bias = attribution.attribution_bias(attribution.model_leaves(m, spark))
        margin = m.transform(features.assemble_features(rows)).select("flow_id", vector_to_array("rawPrediction")[1].alias("m"))
        sums = phi.where(F.col("class") == name).groupBy("flow_id").agg(F.sum("phi").alias("s"))
        assert sums.join(margin, "flow_id").agg(F.max(F.abs(F.col("s") + bias - F.col("m")))).first()[0] < 1e-9
    deep = models.train_binary(data.drop("is_val"), rounds=2, depth=9)
    assert attribution.additivity_error(deep, rows).first().error < 1e-9


def test_attribution_shift_of_two_real_models(spark, data, tier1):
    """The label moves from two features to two others: so do the attributions."""
    moved = data.withColumn("unified_label", F.when(F.col(S.GOLDEN12[1]) * F.col(S.GOLDEN12[9]) > 2, S.DOS).otherwise(S.BENIGN)).drop("is_val")
    phi = attribution.attribute_models({"baseline": tier1, "adapted": models.train_binary(moved, rounds=8, depth=4)}, data.limit(400))
    shift = attribution_shift(phi.where("model = 'baseline'"), phi.where("model = 'adapted'"))
    delta = {r["feature"]: r["shift_delta"] for r in shift.collect()}
    assert len(delta) == 12
    assert set(sorted(delta, key=delta.get)[-2:]) == {S.GOLDEN12[1], S.GOLDEN12[9]} and set(sorted(delta, key=delta.get)[:2]) == {S.GOLDEN12[6], S.GOLDEN12[7]}
