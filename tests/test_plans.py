from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.plans import dataset, live
from flowtide.sources import flows as FL
from flowtide.sources.dimension import label_dimension


def raw(spark, n=300):
    data = [(i, 2018 if i % 2 else 2017, ["BENIGN", "Benign"][i % 2] if i % 3 else ["DoS Hulk", "DoS attacks-Hulk"][i % 2],
             *[float((i * (j + 3)) % 97) + (50.0 if i % 3 == 0 else 0.0) for j in range(12)]) for i in range(n)]
    data.append((n, 2018, "Label", *[0.0] * 12))
    data.append((n + 1, 2018, "Benign", *[float("inf")] * 12))
    return spark.createDataFrame(data, "flow_id long, source_year int, raw_label string, " + ", ".join(f"{c} double" for c in S.GOLDEN12))


def test_golden12_has_no_shuffle(spark):
    df = dataset.golden12(raw(spark), label_dimension(spark), ["flow_id"])
    assert df.count() == 300
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_dataset_keeps_test_rows_real(spark):
    rows, report = dataset.build_dataset(raw(spark), label_dimension(spark), "flow_id", threshold=200, target=150)
    got = {(r["split"], r["origin"]): r["count"] for r in rows.groupBy("split", "origin").count().collect()}
    assert {o for s, o in got if s != "train"} == {"real"}
    assert got[("val", "real")] == got[("test", "real")] == 30
    counts = {(r["stage"], r["unified_label"]): r["rows"] for r in report.collect()}
    assert counts[("input", "DoS_DDoS")] == 80 and counts[("synthesized", "DoS_DDoS")] == 150
    assert counts[("smote", "DoS_DDoS")] == 150 and counts[("downsampled", "BENIGN")] == 160
    first, _ = dataset.build_dataset(raw(spark), label_dimension(spark), "flow_id", balance_first=True, threshold=200, target=250)
    assert first.select("flow_id").distinct().count() == first.count()


def test_ground_truth_of_one_session(spark):
    t0 = datetime(2024, 1, 1)
    flows = spark.createDataFrame([(i, t0 + timedelta(days=30, seconds=10 * i)) for i in range(20)], "flow_id long, ts timestamp_ntz")
    log = spark.createDataFrame([(0, t0, t0 + timedelta(seconds=30), "BOTNET"), (1, t0 + timedelta(seconds=500), t0 + timedelta(seconds=540), "DoS_DDoS"),
                                 (2, t0 + timedelta(seconds=550), t0 + timedelta(seconds=570), "BENIGN")],
                                "log_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, class_label string")
    got = [r["ground_truth_label"] for r in live.ground_truth(flows, log, session_id=1).orderBy("flow_id").collect()]
    assert got == ["DoS_DDoS"] * 5 + ["BENIGN"] * 15


def test_ground_truth_evaluates_the_log_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(c):
        seen.add(1)
        return c

    t0 = datetime(2024, 1, 1)
    flows = spark.createDataFrame([(i, t0 + timedelta(seconds=10 * i)) for i in range(20)], "flow_id long, ts timestamp_ntz")
    log = spark.createDataFrame([(0, t0, t0 + timedelta(seconds=30), "BOTNET"), (1, t0 + timedelta(seconds=100), t0 + timedelta(seconds=110), "DoS_DDoS")],
                                "log_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, class_label string").withColumn("class_label", named("class_label"))
    got = [r["ground_truth_label"] for r in live.ground_truth(flows, log).orderBy("flow_id").collect()]
    assert got == ["BOTNET"] * 4 + ["BENIGN"] * 6 + ["DoS_DDoS"] * 2 + ["BENIGN"] * 8
    assert seen.value == 2


def test_live_units(spark):
    df = raw(spark, 3).select("flow_id", *S.GOLDEN12)
    a, b = live.prepare_live(df).where("flow_id = 1").first(), live.prepare_live(df, seconds=False).where("flow_id = 1").first()
    assert a["flow_duration"] == b["flow_duration"] * 1e6 and a["flow_bytes_s"] == b["flow_bytes_s"]
    assert live.prepare_live(df).where(F.col("flow_id") == 4).first()["flow_iat_mean"] == 0.0


def test_raw_folders_of_both_years(spark, tmp_path):
    """Mixed layouts, broken dashes, repeated header lines, a long row and a zero-duration flow."""
    a, b = tmp_path / "y17", tmp_path / "y18"
    a.mkdir()
    b.mkdir()
    shared = ["Flow Duration", "Fwd PSH Flags", "Flow IAT Mean", "Fwd IAT Max", "Bwd IAT Min"]
    short = [c for c in S.SHORT_TO_LONG]
    n = len(shared) + len(short)
    head17 = [" " + c for c in shared + [S.SHORT_TO_LONG[c] for c in short]]
    dup = head17 + [" Fwd Header Length", " Label"]
    (a / "one.csv").write_bytes((",".join(dup) + "\n" + ",".join(["1"] * (n + 1)) + ",Web Attack \xef\xbf\xbd XSS\n"
                                 + ",".join(["2"] * (n + 1)) + ",BENIGN,extra\n").encode("latin1"))
    head18 = shared + short + ["Protocol", "Timestamp", "Label"]
    rates = ["Infinity" if c in ("Flow Pkts/s", "Flow Byts/s") else "0" for c in shared + short]
    (b / "p.csv").write_text(",".join(head18) + "\n" + ",".join(["3"] * n) + ",6,20/02/2018 08:00:00,Benign\n" + ",".join(head18) + "\n"
                             + ",".join(rates) + ",6,20/02/2018 08:00:00,Benign\n")
    extra = ["Flow ID", "Src IP", "Src Port", "Dst IP"] + head18
    (b / "q.csv").write_text(",".join(extra) + "\nid,10.0.0.1,4,10.0.0.2," + ",".join(["5"] * n) + ",17,20/02/2018 08:34:07,DoS attacks-Hulk\n")
    merged = dataset.merge_raw(spark, {2017: str(a), 2018: str(b)}, label_dimension(spark))
    got = {(r["source_year"], r["file_name"], r["unified_label"], r["Flow Duration"]) for r in merged.collect()}
    assert got == {(2017, "one.csv", "WEB_ATTACK", 1.0), (2018, "p.csv", "BENIGN", 3.0), (2018, "p.csv", "BENIGN", 0.0), (2018, "q.csv", "DoS_DDoS", 5.0)}
    assert "Protocol" not in merged.columns and "Src IP" not in merged.columns
    assert sorted(r["flow_duration"] for r in dataset.select_merged(merged).collect()) == [1.0, 3.0, 5.0]
    withip = [t for t in dataset.read_raw_year(spark, str(b), 2018) if "Src IP" in t.columns][0]
    flow = FL.flows_with_source(withip).first()
    assert (flow["src_ip"], flow["dst_port"], flow["protocol"], str(flow["ts"])) == ("10.0.0.1", 5, 17, "2018-02-20 08:34:07")
