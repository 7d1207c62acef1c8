import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.operators import evaluate, features, quality, setops
from flowtide.sources import flows as FL
from flowtide.sources.dimension import label_dimension
from flowtide.sources.sinks import split_manifest


BEFORE = {"BENIGN": 15757805, "DoS_DDoS": 2298932, "BRUTE_FORCE": 394784, "INFILTRATION": 320900, "BOTNET": 288157, "WEB_ATTACK": 3108}
AFTER = {"BENIGN": 15661569, "DoS_DDoS": 2297981, "BRUTE_FORCE": 394775, "INFILTRATION": 319479, "BOTNET": 288147, "WEB_ATTACK": 3108}
LOST = {"BENIGN": (0.611, 82.581), "DoS_DDoS": (0.041, 12.117), "BRUTE_FORCE": (0.002, 2.082),
        "INFILTRATION": (0.443, 1.685), "BOTNET": (0.003, 1.519), "WEB_ATTACK": (0.0, 0.016)}


def test_class_loss_published_table(spark):
    both = spark.createDataFrame([(c, BEFORE[c], AFTER[c]) for c in BEFORE], "unified_label string, rows_before long, rows_after long")
    for r in quality.loss_table(both).collect():
        lost, total = LOST[r["unified_label"]]
        # the published table has three digits, ours four
        assert abs(r["pct_of_class_lost"] - lost) <= 0.00055
        assert abs(r["pct_of_total_after"] - total) <= 0.00055
        assert not r["flagged"]
        assert r["rows_dropped"] == BEFORE[r["unified_label"]] - AFTER[r["unified_label"]]
        if r["unified_label"] == "WEB_ATTACK":
            assert round(r["imbalance_ratio"]) == 5039
    assert sum(BEFORE.values()) - sum(AFTER.values()) == 98627


def test_class_loss_flags_and_vanished_class(spark):
    before = spark.createDataFrame([("A",)] * 100 + [("B",)] * 3, "unified_label string")
    after = spark.createDataFrame([("A",)] * 98, "unified_label string")
    got = {r["unified_label"]: r for r in quality.class_loss_check(before, after).collect()}
    assert not got["A"]["flagged"]  # exactly 2 % is not above 2 %
    assert got["B"]["flagged"] and got["B"]["rows_after"] == 0 and got["B"]["imbalance_ratio"] is None


def test_schema_guard(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1, 2)], "x int, z int")
    with pytest.raises(quality.SchemaMismatch, match="y.*z"):
        setops.union_sources(a, b)
    with pytest.raises(quality.SchemaMismatch, match="flow_duration"):
        features.select_golden12(a)
    swapped = spark.createDataFrame([(4, 3)], "y int, x int")
    assert {tuple(r) for r in setops.union_sources(a, swapped).collect()} == {(1, 2), (3, 4)}


def test_missing_values_two_policies(spark):
    inf, nan = float("inf"), float("nan")
    base = {c: 1.0 for c in S.GOLDEN12}
    data = [(0, {}), (1, {"flow_packets_s": inf}), (2, {"flow_bytes_s": nan}), (3, {"fwd_iat_max": None}), (4, {"flow_bytes_s": -inf}),
            (5, {"flow_duration": inf})]
    df = spark.createDataFrame([(i, *[{**base, **o}[c] for c in S.GOLDEN12]) for i, o in data],
                               "id int, " + ", ".join(f"{c} double" for c in S.GOLDEN12))
    kept = features.drop_incomplete(features.rates_inf_to_null(df))
    assert sorted(r["id"] for r in kept.collect()) == [0, 5]  # an infinite duration is no rate: kept
    filled = features.impute_zero(df).collect()
    assert {r["id"]: r["flow_packets_s"] for r in filled}[1] == 0.0
    assert {r["id"]: r["flow_duration"] for r in filled}[5] == 0.0
    assert features.impute_zero(df.drop("bwd_iat_min")).first()["bwd_iat_min"] == 0.0
    prof = {r["feature"]: (r["missing"], r["infinite"]) for r in quality.nan_inf_profile(df).collect()}
    assert prof["flow_bytes_s"] == (1, 1) and prof["flow_packets_s"] == (0, 1) and prof["fwd_iat_max"] == (1, 0)


def test_row_reconciliation(spark):
    df = spark.range(100)
    got = [tuple(r) for r in quality.row_reconciliation(df, {"a": F.col("id") < 90, "b": F.col("id") >= 10}).collect()]
    assert got == [(0, "a", 100, 90, 10), (1, "b", 90, 80, 10)]


def test_csv_scan_short_and_long_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("x,y,Label\n1,2,a\n3,4\n5,6,c,extra\n7,8,\"q,r\"\n".encode())
    (tmp_path / "a.csv").write_bytes("x,y,Label\n9,Infinity,\xef\xbf\xbd\n".encode("latin1"))
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.DoubleType()), T.StructField("Label", T.StringType())])
    got = {tuple(r) for r in FL.scan_flow_csv(spark, str(tmp_path), schema, "ISO-8859-1").collect()}
    assert got == {(1, 2.0, "a", "b.csv"), (3, 4.0, None, "b.csv"), (7, 8.0, "q,r", "b.csv"), (9, float("inf"), "ï¿½", "a.csv")}


def test_long_rows_are_dropped_whatever_columns_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n4,5,6,7\n4,5,6,\n8,9\n1,2,3,4,5,6\n4,5,6,\"\"\nx,y,z\n")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
    df = FL.scan_flow_csv(spark, str(tmp_path), schema)
    assert df.count() == 3
    assert [r["x"] for r in df.select("x").collect()] == [1.0, 8.0, None]
    assert [r["z"] for r in df.select("z").collect()] == [3.0, None, None]
    assert [r["y"] for r in df.where("x > 1").select("y").collect()] == [9.0]


def test_files_encoding_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y,z\n1,2,3\n")
    (tmp_path / "b.csv").write_bytes(b"x, y,w\n1,2,\xe9\n4,5,6\n")
    enc = {r["file_name"]: (r["bad_lines"], r["verdict"]) for r in quality.profile_encoding(spark, str(tmp_path)).collect()}
    assert enc == {"a.csv": (0, "utf-8"), "b.csv": (1, "latin1")}
    assert {r["file_name"]: r["rows"] for r in quality.profile_files(spark, str(tmp_path)).collect()} == {"a.csv": 1, "b.csv": 2}
    got = {(r["file_name"], r["column_name"], r["issue"], r["layouts"])
           for r in quality.schema_consistency(quality.file_headers(spark, str(tmp_path))).collect()}
    assert got == {("a.csv", None, None, 2), ("b.csv", " y", "padded", 2), ("b.csv", "y", "missing", 2), ("b.csv", "z", "missing", 2),
                   ("b.csv", " y", "extra", 2), ("b.csv", "w", "extra", 2)}


def test_header_reads_take_the_first_record_only(spark, tmp_path):
    long = b'id,"a, b","line\nbreak", c\n' + b"1,2,3,4\n" * 200000
    (tmp_path / "long file.csv").write_bytes(long)
    (tmp_path / "bare + line.csv").write_bytes(b"\n")
    (tmp_path / "mark%20.csv").write_bytes(b"\xef\xbb\xbfid\r\n1\r\n")
    got = {r["file_name"]: r["columns"] for r in quality.file_headers(spark, str(tmp_path)).collect()}
    assert got == {"long file.csv": ["id", "a, b", "line\nbreak", " c"], "bare + line.csv": [""], "mark%20.csv": ["id"]}
    files = {r["file_name"]: tuple(r)[1:] for r in quality.profile_files(spark, str(tmp_path)).collect()}
    assert files["bare + line.csv"] == (0, 0.0, 1) and files["long file.csv"] == (200001, 1.53, len(long))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    for size in (10**5, 10**6):
        f = Counting(b"x,y\n" + b"1,2\n" * size)
        assert quality.first_record(f.read) == ["x", "y"] and f.taken == quality.HEAD_BYTES
    wide = ",".join(f"c{i}" for i in range(40000)).encode()
    assert len(quality.first_record(io.BytesIO(wide + b"\n1").read)) == 40000 == len(quality.first_record(io.BytesIO(wide).read))


def test_label_census_lists_most_rows_first(spark):
    df = spark.createDataFrame([("f", 2018, "Benign")] * 2 + [("f", 2018, "Bot")] * 3 + [("f", 2018, "?")] + [("e", 2018, "Benign")],
                               "file_name string, source_year int, raw_label string")
    census = quality.label_census(df, label_dimension(spark)).collect()
    assert [(r["file_name"], r["raw_label"], r["rows"]) for r in census] == [("e", "Benign", 1), ("f", "Bot", 3), ("f", "Benign", 2), ("f", "?", 1)]


def test_canonical_columns_both_layouts(spark):
    short = spark.createDataFrame([(1, 2, 3, "t", "id", "Benign")], ["Tot Fwd Pkts", "Dst Port", "Protocol", "Timestamp", "Flow ID", "Label"])
    assert FL.canonical_columns(short, True).columns == ["Total Fwd Packets", "Destination Port", "Label"]
    long = spark.createDataFrame([(1.0, 2.0, 2.0, "x")], [" Flow Duration", "Fwd Header Length", "Fwd Header Length.1", " Label"])
    out = FL.canonical_columns(long, False)
    assert out.columns == ["Flow Duration", "Fwd Header Length", "Label"]
    assert FL.to_engine_names(out).columns == ["flow_duration", "fwd_header_length", "Label"]
    assert len(set(S.SHORT_TO_LONG.values())) == 50


def test_repeated_header_kept_once_whatever_the_reader_calls_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Fwd Header Length, Flow Duration, Fwd Header Length\n1,2,1\n")
    raw = spark.read.option("header", True).csv(str(tmp_path))
    assert " Fwd Header Length" not in raw.columns
    assert FL.canonical_columns(raw, False).columns == ["Fwd Header Length", "Flow Duration"]


def test_day_first_timestamps(spark):
    df = spark.createDataFrame([("20/02/2018 08:34:07",), ("02/13/2018 01:00:00",), ("junk",), (None,)], "t string")
    assert [str(r["t"]) for r in FL.parse_timestamps(df, "t").collect()] == ["2018-02-20 08:34:07"]
    assert tuple(FL.unparsed_timestamps(df, "t").first()) == (4, 3)


def test_split_checks_published(spark):
    counts = {"DoS_DDoS": (2212639, 67.199), "BRUTE_FORCE": (394339, 11.976), "BOTNET": (286968, 8.715),
              "INFILTRATION": (210704, 6.399), "BENIGN": (168016, 5.103), "WEB_ATTACK": (20000, 0.607)}
    total = sum(n for n, _ in counts.values())
    assert total == 3292666 == 3620199 - 327533
    df = spark.createDataFrame([(c, n) for c, (n, _) in counts.items()], "unified_label string, n long")
    for r in df.withColumn("pct", F.round(F.col("n") * 100.0 / total, 3)).collect():
        assert r["pct"] == counts[r["unified_label"]][1]


def test_manifest_and_balance(spark):
    df = spark.createDataFrame([("train", "A")] * 8 + [("val", "A")] + [("test", "A")] + [("train", "B")] * 4 + [("test", "B")], "split string, unified_label string")
    m = {(r["split"], r["unified_label"]): (r["rows"], r["class_pct_full"]) for r in split_manifest(df).collect()}
    assert m[("train", "A")] == (8, 66.667) and m[("test", "B")] == (1, 33.333)
    assert {r["passed"] for r in quality.split_balance_check(df).collect()} == {False}


def test_worst_imbalance(spark):
    df = spark.createDataFrame([("A",)] * 9 + [("B",)] * 2 + [("C",)] * 2, "unified_label string")
    assert tuple(evaluate.worst_imbalance(df).first()) == (9, "B", 2, 4.5)
    assert [tuple(r) for r in evaluate.count_order(df, "unified_label").collect()] == [("A", 9), ("B", 2), ("C", 2)]
