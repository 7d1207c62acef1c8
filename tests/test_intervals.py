from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from flowtide.operators import intervals, packets, quality
from flowtide.operators.intervals import label_by_interval, winner_segments

T0 = datetime(2024, 3, 1)


def log_of(spark, items):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=float(a)), T0 + timedelta(seconds=float(b)), c) for i, (a, b, c) in enumerate(items)],
                                 "log_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, class_label string")


def flows_of(spark, secs):
    return spark.createDataFrame([(i, None if s is None else T0 + timedelta(seconds=float(s))) for i, s in enumerate(secs)],
                                 "flow_id long, ts timestamp_ntz")


def brute(secs, items):
    out = []
    order = sorted(range(len(items)), key=lambda i: (items[i][0], i))
    for s in secs:
        label = "BENIGN"
        for i in order:
            a, b, c = items[i]
            if c != "BENIGN" and s is not None and a <= s <= b:
                label = c
        out.append(label)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [200_000, 0])
def test_interval_labels_match_brute_force(spark, seed, limit):
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, 200, 25)
    items = [(int(a), int(a) + int(rng.integers(0, 60)), str(rng.choice(["BENIGN", "DoS_DDoS", "BOTNET", "WEB_ATTACK"]))) for a in starts]
    secs = [None] + [float(x) for x in rng.integers(-20, 300, 150)] + [items[0][0], items[0][1], items[0][1] + 0.000001]
    got = label_by_interval(flows_of(spark, secs), log_of(spark, items), broadcast_rows=limit)
    assert [r["ground_truth_label"] for r in got.orderBy("flow_id").collect()] == brute(secs, items)


def test_segments_are_disjoint_and_few(spark):
    items = [(0, 1000, "A")] + [(10 * i, 10 * i + 5, "B") for i in range(50)]
    seg = winner_segments(log_of(spark, items))
    rows = seg.orderBy("seg_us").collect()
    assert len(rows) <= 2 * len(items)
    assert len({r["seg_us"] for r in rows}) == len(rows)


def test_one_crowded_moment_takes_the_sorted_path(spark, monkeypatch):
    """A third of the flows at one instant and a dense log must still be labelled whole."""
    monkeypatch.setattr(intervals, "MAX_SEGMENTS_PER_BUCKET", 1)
    items = [(i * 0.01, i * 0.01 + 0.005, "BOTNET") for i in range(100)] + [(5000, 5001, "DoS_DDoS")]
    secs = [0.502] * 100 + [0.507] * 100 + [5000.5] * 50
    got = label_by_interval(flows_of(spark, secs), log_of(spark, items)).groupBy("ground_truth_label").count()
    assert {r[0]: r[1] for r in got.collect()} == {"BOTNET": 100, "BENIGN": 100, "DoS_DDoS": 50}


def test_empty_log(spark):
    got = label_by_interval(flows_of(spark, [1, 2]), log_of(spark, [(0, 9, "BENIGN")]))
    assert {r["ground_truth_label"] for r in got.collect()} == {"BENIGN"}


def test_sessions_match_pandas(spark):
    rng = np.random.default_rng(1)
    starts = np.sort(rng.integers(0, 20000, 300)).astype(float)
    items = [(s, s + float(rng.integers(1, 90)), "X") for s in starts]
    pdf = pd.DataFrame(items, columns=["s", "e", "c"])
    gap = pdf.s - pdf.e.shift(1)
    want = (gap > 60).cumsum()
    got = intervals.sessionize(log_of(spark, items)).orderBy("log_id").collect()
    assert [r["session_id"] for r in got] == want.tolist()
    assert np.allclose([np.nan if r["gap_sec"] is None else r["gap_sec"] for r in got], gap, equal_nan=True)


def test_gap_of_sixty_seconds_stays_in_session(spark):
    log = log_of(spark, [(0, 10, "A"), (70, 80, "A"), (140.000001, 150, "A")])
    assert [r["session_id"] for r in intervals.sessionize(log).orderBy("start_ts").collect()] == [0, 0, 1]
    assert intervals.pick_session(intervals.sessionize(log), 1).count() == 1


def test_equal_starts_are_ordered_by_id(spark):
    log = log_of(spark, [(0, 500, "A"), (0, 10, "A"), (0, 20, "A"), (100, 120, "A")])
    got = {r["log_id"]: r["gap_sec"] for r in intervals.session_gap(log).collect()}
    assert got == {0: None, 1: -500.0, 2: -10.0, 3: 80.0}


def test_align_and_coverage(spark):
    flows = flows_of(spark, [1000.25, 1030, 2000, None])
    moved = intervals.align_clocks(flows, log_of(spark, [(5, 10, "A"), (30, 40, "B")]))
    r = moved.orderBy("log_id").collect()
    assert r[0]["start_ts"] == T0 + timedelta(seconds=1000.25) and r[1]["end_ts"] == T0 + timedelta(seconds=1035.25)
    assert tuple(quality.label_coverage_check(flows, moved).first()) == (4, 2)


def test_packets(spark):
    a = spark.createDataFrame([(1, 1, 10.0, 0), (1, 1, 11.0, 1), (1, 2, 5.0, 2), (2, 9, 1.0, 3)], "icmp_id int, icmp_seq int, ts double, n int")
    b = spark.createDataFrame([(1, 1, 11.0005, 0), (1, 2, 4.0, 1), (3, 3, 1.0, 2)], "icmp_id int, icmp_seq int, ts double, n int")
    keys = ["icmp_id", "icmp_seq"]
    m = packets.match_packets(packets.last_write_wins(a, keys, ["ts", "n"]), packets.last_write_wins(b, keys, ["ts", "n"]), keys)
    assert {(r["icmp_id"], r["icmp_seq"]): round(r["latency_ms"], 6) for r in m.collect()} == {(1, 1): 0.5, (1, 2): -1000.0}
    assert tuple(packets.unmatched_packets(a, b, keys).first()) == (2, 1, 1)
    assert tuple(quality.negative_latency_check(m).first()) == (2, 1)


def test_sessions_with_open_ends_do_not_depend_on_blocks(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=100 * i), None if i % 3 == 1 else t0 + timedelta(seconds=100 * i + (90 if i % 4 else 10))) for i in range(40)]
    log = spark.createDataFrame(rows, "log_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    want, session = [], 0
    for i, start, _ in rows:
        end = rows[i - 1][2] if i else None
        session += end is not None and (start - end).total_seconds() > 60
        want.append(session)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert [r.session_id for r in intervals.sessionize(log).orderBy("log_id").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
