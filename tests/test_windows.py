import math
from datetime import datetime, timedelta

import numpy as np

from flowtide import schema as S
from flowtide.operators import windows

T0 = datetime(2018, 2, 20, 8, 0)


def frame(spark, items):
    """items: (seconds, src, port, protocol, label, value of every feature)"""
    data = [(T0 + timedelta(seconds=s), src, port, proto, label, *[float(v)] * 12) for s, src, port, proto, label, v in items]
    return spark.createDataFrame(data, "ts timestamp_ntz, src_ip string, dst_port int, protocol int, unified_label string, "
                                 + ", ".join(f"{c} double" for c in S.GOLDEN12))


def entropy(xs):
    _, c = np.unique([x for x in xs if x is not None], return_counts=True)
    p = c / c.sum()
    return float(-(p * np.log2(p)).sum())


def test_vector_of_one_window(spark):
    items = [(0, "a", 80, 6, "BENIGN", 1), (10, "a", 80, 6, "BOTNET", 2), (299, "a", 443, 17, "DoS_DDoS", 6), (300, "a", 1, 1, "BENIGN", 0)]
    out = {r["window_start"]: r for r in windows.tier2_windows(frame(spark, items)).collect()}
    r = out[T0]
    assert r["flow_count"] == 3 and r["mean_flow_duration"] == 3.0 and r["mean_bwd_iat_min"] == 3.0
    assert math.isclose(r["destination_port_entropy"], entropy([80, 80, 443]), abs_tol=1e-9)
    assert r["unique_destination_ports"] == 2 and math.isclose(r["attack_flow_fraction"], 2 / 3)
    assert r["window_label"] == "BOTNET"  # tie goes to the first name
    other = out[T0 + timedelta(minutes=5)]
    assert other["window_label"] == "BENIGN" and other["protocol_entropy"] == 0.0
    model_inputs = [c for c in r.asDict() if c not in ("src_ip", "window_start", "window_label", "attack_flow_fraction")]
    assert len(model_inputs) == 16


def test_hot_source_and_random_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 3000
    items = [(int(s), "hot" if i % 3 == 0 else f"s{i % 50}", int(p), int(q), str(c), float(v)) for i, (s, p, q, c, v) in enumerate(zip(
        rng.integers(0, 1500, n), rng.integers(1, 30, n), rng.choice([1, 6, 17], n), rng.choice(["BENIGN", "DoS_DDoS", "WEB_ATTACK"], n), rng.random(n)))]
    got = {(r["src_ip"], r["window_start"]): r for r in windows.tier2_windows(frame(spark, items)).collect()}
    groups = {}
    for it in items:
        groups.setdefault((it[1], T0 + timedelta(seconds=it[0] // 300 * 300)), []).append(it)
    assert set(got) == set(groups)
    for k, g in groups.items():
        r = got[k]
        assert r["flow_count"] == len(g) and r["unique_destination_ports"] == len({x[2] for x in g})
        assert math.isclose(r["mean_flow_bytes_s"], np.mean([x[5] for x in g]), rel_tol=1e-9)
        assert math.isclose(r["protocol_entropy"], entropy([x[3] for x in g]), abs_tol=1e-8)
        assert 0 <= r["destination_port_entropy"] <= math.log2(r["unique_destination_ports"]) + 1e-9


def test_entropy_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 7)], "k string, v int")
    assert {r["k"]: r["entropy"] for r in windows.shannon_entropy(df, ["k"], "v").collect()} == {"a": 1.0, "b": 0.0}


def test_null_port_counts_in_means_only(spark):
    r = windows.tier2_windows(frame(spark, [(0, "a", None, 6, "BENIGN", 2), (1, "a", 80, 6, "BENIGN", 4)])).first()
    assert (r["flow_count"], r["mean_flow_duration"], r["unique_destination_ports"], r["destination_port_entropy"]) == (2, 3.0, 1, 0.0)


def test_label_and_cardinality(spark):
    items = [(0, "a", 1, 6, "WEB_ATTACK", 0)] * 2 + [(0, "a", 1, 6, "BENIGN", 0)] * 5 + [(0, "a", 2, 6, "BOTNET", 0)] + [(400, "b", 3, 6, "BENIGN", 0)]
    df = windows.with_window_start(frame(spark, items))
    keys = ["src_ip", "window_start"]
    assert {r["src_ip"]: r["window_label"] for r in windows.window_label(df, keys).collect()} == {"a": "WEB_ATTACK", "b": "BENIGN"}
    assert {r["src_ip"]: r["attack_flow_fraction"] for r in windows.attack_fraction(df, keys).collect()} == {"a": 3 / 8, "b": 0.0}
    assert tuple(windows.window_cardinality(df).first()) == (2, 2, 3, 2)
    assert tuple(windows.window_cardinality(df, approximate=True).first()) == (2, 2, 3, 2)


def test_one_shuffle_after_the_first_aggregate(spark):
    plan = windows.tier2_windows(frame(spark, [(0, "a", 1, 6, "BENIGN", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Window" not in plan and "Join" not in plan
