import json
import math

from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.cascade import alerts, block_requests, cascade_decide
from flowtide.sources import events as E
from flowtide.sources import flows as FL
from flowtide.sources import packets as PK

LINES = [
    json.dumps({"event_type": "flow", "src_ip": "1.2.3.4", "src_port": 5, "dest_ip": "9.9.9.9", "dest_port": 80, "proto": "TCP",
                "flow": {"age": 2, "pkts_toserver": 10, "pkts_toclient": 4, "bytes_toserver": 1000, "bytes_toclient": 400},
                "tcp": {"psh": True, "ack": False, "window": 8192}}),
    json.dumps({"event_type": "alert"}),
    json.dumps({"event_type": "netflow", "flow": {"age": 0, "pkts_toserver": 0, "pkts_toclient": 0}, "src_ip": None}),
    json.dumps({"event_type": "dns"}),
    "", "   ", "{broken", "[1, 2]", "null", '{"event_type": "flow"} tail', "{'event_type': 'flow'}", '{"event_type": "flow",}',
]


def events(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "n int, value string")
    return E.parse_ids_events(lines)


def test_lines(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert events(spark).count() == 4
    assert E.filter_event_types(events(spark)).count() == 3
    assert tuple(E.ids_line_counts(lines).first()) == (12, 2, 6, 4)


def test_features_and_defaults(spark):
    got = {r["n"]: r for r in E.ids_event_features(E.filter_event_types(events(spark))).collect()}
    a = got[0]
    want = [400.0, 160.0, 1.0, 0.0, 8192.0, 2e6, 7.0, 700.0, 100.0, 2e6 / 14, 2e5, 5e5]
    assert all(math.isclose(a[c], w) for c, w in zip(S.GOLDEN12, want))
    b = got[1]  # nothing given: one packet of 64 bytes in 0.037 s
    want = [40.0, 0.0, 0.0, 1.0, 512.0, 37000.0, 1 / .037, 64 / .037, 64.0, 37000.0, 37000.0, 0.0]
    assert all(math.isclose(b[c], w) for c, w in zip(S.GOLDEN12, want))
    c = got[2]  # zero age counts as a millisecond, zero packets as one
    assert (c["flow_duration"], c["fwd_packet_length_max"], c["flow_iat_mean"], c["bwd_iat_min"]) == (1000.0, 64.0, 1000.0, 0.0)


def test_tuple_defaults(spark):
    got = {r["n"]: (r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["proto"]) for r in E.ids_event_tuple(events(spark)).collect()}
    assert got[0] == ("1.2.3.4", 5, "9.9.9.9", 80, "TCP")
    assert got[2] == got[1] == ("0.0.0.0", 0, "0.0.0.0", 0, "TCP")


def scored(spark):
    rows = [(0, 0.5001, [1.0, 0, 0, 0, 0, 0]), (1, 0.5, [0.1, 0, 0.9, 0, 0, 0]), (2, 0.0, [.2, .2, .2, .2, .2, 0]),
            (3, 0.1, [0, 0, 0, .5, 0, .5]), (4, None, [0, 0, 0, 0, 1.0, 0])]
    df = spark.createDataFrame([(i, p, [float(x) for x in q], "a" if i < 3 else "b") for i, p, q in rows],
                               "flow_id long, p1 double, probs array<double>, src_ip string")
    return df.withColumns({"ts": F.timestamp_seconds(F.lit(1000) - F.col("flow_id")), "dst_ip": F.lit("x"), "dst_port": F.lit(1)})


def test_decisions_and_severity(spark):
    got = {r["flow_id"]: (r["severity"], r["predicted_class"], r["pipeline_tier"]) for r in cascade_decide(scored(spark)).collect()}
    assert got == {0: ("CRITICAL", "DoS_DDoS", S.TIER1), 1: ("HIGH", "BRUTE_FORCE", S.TIER3), 2: (None, "BENIGN", S.TIER3),
                   3: ("MEDIUM", "INFILTRATION", S.TIER3), 4: ("HIGH", "BOTNET", S.TIER3)}
    al = alerts(cascade_decide(scored(spark)))
    assert al.count() == 4 and al.where("flow_id = 0").first()["confidence"] == 0.5001
    got = {r["src_ip"]: (r["n_alerts"], r["predicted_class"]) for r in block_requests(al).collect()}
    assert got == {"a": (2, "BRUTE_FORCE"), "b": (2, "BOTNET")}


def test_live_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",".join(S.LIVE_FLOW.names) + "\n2024-01-01 00:00:01,1.1.1.1,2.2.2.2,80," + ",".join(["1.5"] * 12)
                                    + "\nnot a time,1.1.1.1,2.2.2.2,80," + ",".join(["NaN"] * 12) + "\n")
    df = FL.read_live_flows(spark, str(tmp_path))
    assert df.where("ts is null").count() == 1
    assert FL.scale_time_units(df).where("ts is not null").first()["bwd_iat_min"] == 1.5e6
    assert df.where("ts is not null").first()["flow_bytes_s"] == 1.5


def test_attack_log(spark, tmp_path):
    (tmp_path / "g.csv").write_text("timestamp_start,timestamp_end,class_label,src_ip,dst_ip,dst_port,tool,detail\n"
                                    "2024-01-01T00:00:00+00:00,2024-01-01T00:01:00+00:00,DoS_DDoS,a,b,80,t,d\n"
                                    "2024-01-01T01:00:00+01:00,2024-01-01T00:02:00Z,BENIGN,a,b,80,t,d\n")
    rows = FL.read_attack_log(spark, str(tmp_path)).orderBy("end_ts").collect()
    assert rows[0]["start_ts"] == rows[1]["start_ts"] and rows[0]["log_id"] != rows[1]["log_id"]


def test_packet_kinds(spark):
    df = spark.createDataFrame([("o", 8), ("o", 0), ("o", 3), ("o", 8), ("i", 8)], "point string, icmp_type int")
    assert PK.read_packets(df).count() == 3
    assert {tuple(r) for r in PK.packet_counts(df).collect()} == {("o", 4, 2, 1, 1), ("i", 1, 1, 0, 0)}
