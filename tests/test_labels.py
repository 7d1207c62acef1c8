"""Label strings as the raw files spell them, with the class each must get."""

import pytest
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import class_code, class_name, normalize_label
from flowtide.operators import labels, quality
from flowtide.sources.dimension import class_dimension, label_dimension, write_label_dimension
from flowtide.session import scratch_path

RAW = [
    (2017, "DDoS", "DoS_DDoS"), (2017, "BENIGN", "BENIGN"), (2017, "PortScan", "INFILTRATION"), (2017, "Bot", "BOTNET"),
    (2017, "Infiltration", "INFILTRATION"), (2017, "Web Attack ï¿½ Brute Force", "WEB_ATTACK"),
    (2017, "Web Attack ï¿½ XSS", "WEB_ATTACK"), (2017, "Web Attack ï¿½ Sql Injection", "WEB_ATTACK"),
    (2017, "FTP-Patator", "BRUTE_FORCE"), (2017, "SSH-Patator", "BRUTE_FORCE"), (2017, "DoS Hulk", "DoS_DDoS"),
    (2017, "DoS GoldenEye", "DoS_DDoS"), (2017, "DoS slowloris", "DoS_DDoS"), (2017, "DoS Slowhttptest", "DoS_DDoS"),
    (2017, "Heartbleed", "DoS_DDoS"),
    (2018, "Benign", "BENIGN"), (2018, "FTP-BruteForce", "BRUTE_FORCE"), (2018, "SSH-Bruteforce", "BRUTE_FORCE"),
    (2018, "DoS attacks-GoldenEye", "DoS_DDoS"), (2018, "DoS attacks-Slowloris", "DoS_DDoS"),
    (2018, "DoS attacks-Hulk", "DoS_DDoS"), (2018, "DoS attacks-SlowHTTPTest", "DoS_DDoS"),
    (2018, "DDoS attacks-LOIC-HTTP", "DoS_DDoS"), (2018, "DDOS attack-HOIC", "DoS_DDoS"),
    (2018, "DDOS attack-LOIC-UDP", "DoS_DDoS"), (2018, "Brute Force -Web", "WEB_ATTACK"),
    (2018, "Brute Force -XSS", "WEB_ATTACK"), (2018, "SQL Injection", "WEB_ATTACK"),
    (2018, "Infilteration", "INFILTRATION"), (2018, "Bot", "BOTNET"),
]


def test_every_known_label_maps(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RAW)], "i int, source_year int, raw_label string, want string")
    got = labels.clean_labels(df, label_dimension(spark))
    assert got.count() == len(RAW)
    assert got.where("unified_label <> want").count() == 0


def test_header_and_unknown_rows(spark):
    df = spark.createDataFrame([(2018, "Label"), (2018, "  lAbEl "), (2018, "Mystery"), (2018, None), (2018, "Benign")],
                               "source_year int, raw_label string")
    keyed = labels.with_label_key(df)
    assert labels.drop_header_rows(keyed).count() == 3
    mapped = labels.map_label(keyed, label_dimension(spark))
    assert labels.drop_unmapped(mapped).count() == 1
    assert labels.clean_labels(df, label_dimension(spark)).count() == 1
    un = {(r["label_key"], r["verdict"]): r["rows"] for r in quality.unmapped_labels(df, label_dimension(spark)).collect()}
    assert un == {("label", "DROP"): 2, ("mystery", "UNMAPPED"): 1, (None, "UNMAPPED"): 1}


@pytest.mark.parametrize("raw,key", [("  A -  B\t c ", "a b c"), ("x", "x"), ("Web Attack ï¿½ XSS", "web attack xss")])
def test_key(spark, raw, key):
    assert spark.range(1).select(normalize_label(F.lit(raw)).alias("k")).first()["k"] == key


def test_class_codes_round_trip(spark):
    d = class_dimension(spark).withColumn("c", class_code("unified_label")).withColumn("n", class_name("c"))
    assert d.where("c <> class_code or n <> unified_label").count() == 0
    assert d.count() == 6


def test_dimension_from_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"2017": {"benign": "BENIGN"},\n "2018": {"bot": "BOTNET", "x": "BENIGN"}, "encoding_2017": "latin1"}')
    got = {tuple(r) for r in label_dimension(spark, str(tmp_path / "m.json")).collect()}
    assert got == {(2017, "benign", "BENIGN"), (2018, "bot", "BOTNET"), (2018, "x", "BENIGN")}
    path = scratch_path(spark, "dim")
    write_label_dimension(label_dimension(spark), path)
    assert spark.read.json(path).count() == sum(len(m) for m in S.LABEL_MAP.values())


def test_clean_labels_computes_each_key_once(spark):
    """The null test that the join brings along needs no second key; a row without a label goes."""
    df = spark.createDataFrame([(1, 2018, " Benign "), (2, 2017, None), (3, 2017, ""), (4, None, "BENIGN")], "flow_id long, source_year int, raw_label string")
    got = labels.clean_labels(df, label_dimension(spark))
    assert [(r["flow_id"], r["label_key"], r["unified_label"]) for r in got.collect()] == [(1, "benign", "BENIGN")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
