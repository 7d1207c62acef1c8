"""Published confusion matrices in, published metrics out."""

import numpy as np
import pytest

from flowtide.operators import cascade, evaluate, quantiles
from pyspark.sql import functions as F

NAMES = ["BENIGN", "BOTNET", "BRUTE_FORCE", "DoS_DDoS", "INFILTRATION", "WEB_ATTACK"]
TIER1 = (["NOT", "DoS_DDoS"], [[106393, 1610], [344, 220920]])
FIRST = (NAMES, [[16433, 0, 0, 9, 344, 16], [1, 28695, 0, 1, 0, 0], [0, 0, 37841, 1593, 0, 0], [1, 0, 343, 220920, 0, 0],
                 [1610, 1, 0, 0, 19459, 0], [8, 0, 0, 2, 0, 1990]])
SECOND = (NAMES, [[16542, 6, 1, 62, 166, 25], [3, 28694, 0, 0, 0, 0], [1, 0, 39140, 293, 0, 0], [6, 0, 372, 220882, 3, 1],
                  [2088, 4, 3, 11, 18964, 0], [22, 1, 1, 9, 2, 1965]])


def matrix(spark, m, tag="m"):
    names, cells = m
    return spark.createDataFrame([(tag, names[i], names[j], cells[i][j]) for i in range(len(names)) for j in range(len(names))],
                                 "model string, y_true string, y_pred string, n long")


@pytest.mark.parametrize("m,acc,macro,weighted", [(FIRST, .988067, .976538, .988045), (SECOND, .990646, .975086, .990670)])
def test_published_reports(spark, m, acc, macro, weighted):
    r = evaluate.overall_report(matrix(spark, m)).first()
    assert (r["accuracy"], r["macro_f1"], r["weighted_f1"]) == (acc, macro, weighted)
    assert r["n_rows"] == 329267


def test_per_class_published(spark):
    got = {r["label"]: r for r in evaluate.per_class_report(matrix(spark, FIRST)).collect()}
    assert [round(got["INFILTRATION"][c], 4) for c in ("precision", "recall", "f1")] == [.9826, .9235, .9522]
    assert got["BRUTE_FORCE"]["support"] == 39434


def test_tier1_published(spark):
    r = evaluate.per_class_report(matrix(spark, TIER1)).where("label = 'DoS_DDoS'").first()
    assert [round(r[c], 4) for c in ("precision", "recall", "f1")] == [.9928, .9984, .9956]
    assert round(evaluate.overall_report(matrix(spark, TIER1)).first()["accuracy"], 4) == .9941


def test_winner_is_macro_f1_not_accuracy(spark):
    both = matrix(spark, FIRST, "one").unionAll(matrix(spark, SECOND, "two"))
    w = evaluate.compare_models(evaluate.overall_report(both, by=["model"])).where("winner").first()
    assert w["model"] == "one"


def test_zero_division_and_empty_cells(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "y_true string, y_pred string")
    cm = evaluate.confusion_matrix(df)
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 3
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.per_class_report(cm).collect()}
    assert got["B"] == (0.0, 0.0, 0.0, 0) and got["C"] == (0.0, 0.0, 0.0, 1)
    assert evaluate.confusion_matrix(df, labels=["A", "B", "C", "D"]).count() == 16


def test_live_published(spark):
    cells = [("DoS_DDoS", "DoS_DDoS", 2834), ("DoS_DDoS", "X", 59), ("X", "X", 58), ("X", "DoS_DDoS", 88)]
    df = spark.createDataFrame(cells, "y_true string, y_pred string, n int").withColumn("config", F.lit("baseline"))
    df = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = evaluate.performance_table(df).first()
    assert (r["n_rows"], r["accuracy_pct"], r["dos_precision"], r["dos_recall"], r["dos_f1"]) == (3039, 95.16, .9699, .9796, .9747)


def test_stream_shares_published(spark):
    d = spark.range(4341).select((F.col("id") < 4187).alias("tier1_hit"), F.lit("CRITICAL").alias("severity"))
    t = cascade.realtime_table(cascade.stream_metrics(d, elapsed_sec=4341 * 773.10e-6)).first()
    assert (t["offload_pct"], t["escalation_pct"], t["avg_latency_us"]) == (96.45, 3.55, 773.1)
    assert abs(t["throughput_fps"] - 1293.49) < 0.01


@pytest.mark.parametrize("small", [100_000, 10])
def test_exact_quantiles_match_numpy(spark, monkeypatch, small):
    """Both the whole-group and the bracketed path; one group holds most rows and many copies."""
    monkeypatch.setattr(quantiles, "SMALL_GROUP", small)
    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([np.full(9000, 1.5), rng.lognormal(0, 2, 21000)]), "few": rng.normal(size=7), "one": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x], "g string, v double").repartition(5)
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    if small == 10:
        data = {"hot": data["hot"]}
        df = df.where("g = 'hot'")
    for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect():
        assert np.allclose(r["q"], np.quantile(data[r["g"]], probs), rtol=0, atol=1e-12)
        assert r["n"] == len(data[r["g"]])
    alone = quantiles.exact_quantiles(df.where("g = 'hot'"), [], "v", probs).first()
    assert np.allclose(alone["q"], np.quantile(data["hot"], probs), atol=1e-12)


def test_quantiles_keep_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: (2, [2.0]), "a": (1, [2.0])}


def test_latency_target_is_strict(spark):
    s = spark.createDataFrame([("t", "total_ms", 0.5, 0.4)], "tier string, stage string, mean double, p95 double")
    r = evaluate.latency_target(s, 0.5).first()
    assert (r["mean_ok"], r["p95_ok"]) == (False, True)


def test_attribution_tables(spark):
    b = spark.createDataFrame([("a", -2.0), ("a", 1.0), ("b", 0.5), ("b", .5)], "feature string, phi double")
    a = spark.createDataFrame([("a", .1), ("a", -.1), ("b", -3.0), ("b", 3.0)], "feature string, phi double")
    shift = evaluate.attribution_shift(b, a)
    assert [r["feature"] for r in shift.collect()] == ["b", "a"]
    assert {r["model"]: r["feature"] for r in evaluate.primary_driver(shift).collect()} == {"baseline": "a", "adapted": "b"}
    assert evaluate.top_features(shift, 1).first()["feature"] == "b"


def test_null_classes_are_counted(spark):
    rows = [("a", "a"), ("a", None), (None, "a"), ("b", "a"), (None, None)]
    cm = evaluate.confusion_matrix(spark.createDataFrame(rows, "y_true string, y_pred string"))
    got = {(r.y_true, r.y_pred): r.n for r in cm.collect()}
    assert len(got) == 9 and sum(got.values()) == 5 and got[None, "a"] == got["a", None] == got[None, None] == 1
    rep = evaluate.overall_report(cm).first()
    assert rep.n_rows == 5 and rep.accuracy == 0.4


def test_scores_that_are_no_numbers(spark):
    nan = float("nan")
    rows = [(1, nan, [0.2, nan, 0.5, 0.1, 0.1, 0.1]), (2, None, [nan] * 6), (3, 0.9, None), (4, 0.5, [0.9, 0.1, 0.0, 0.0, 0.0, 0.0])]
    scored = spark.createDataFrame(rows, "flow_id long, p1 double, probs array<double>")
    got = {r.flow_id: r for r in cascade.cascade_decide(scored).collect()}
    assert [got[i].tier1_hit for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert got[1].confidence == 0.5 and got[1].severity is not None
    assert got[2].predicted_class is None and got[2].severity is None
    assert got[3].severity == "CRITICAL" and got[4].severity is None
    assert tuple(cascade.unscored(scored).first()) == (4, 2, 3)
