import hashlib

import pytest
from pyspark.sql import functions as F

from flowtide.operators import sampling
from flowtide.sources.sinks import read_manifest, write_splits
from flowtide.session import scratch_path

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def key(i, seed):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def test_published_split_sizes(spark):
    """3,292,666 rows, one class with two thirds of them, exact sizes per split and class."""
    counts = [("DoS_DDoS", 2212639), ("BRUTE_FORCE", 394339), ("BOTNET", 286968), ("INFILTRATION", 210704), ("BENIGN", 168016), ("WEB_ATTACK", 20000)]
    label, edge = None, 0
    for c, n in counts:
        edge += n
        label = F.when(F.col("id") < edge, c) if label is None else label.when(F.col("id") < edge, c)
    df = spark.range(edge).withColumn("unified_label", label)
    split = sampling.stratified_split(df, "unified_label", "id", RATIOS)
    got = {(r["split"], r["unified_label"]): r["count"] for r in split.groupBy("split", "unified_label").count().collect()}
    size = {s: sum(n for (t, _), n in got.items() if t == s) for s in RATIOS}
    assert size == {"train": 2634132, "val": 329267, "test": 329267}
    assert got[("train", "DoS_DDoS")] == 1770111 and got[("val", "DoS_DDoS")] == got[("test", "DoS_DDoS")] == 221264
    assert got[("test", "BENIGN")] == 16802 and got[("test", "INFILTRATION")] == 21070 and got[("test", "WEB_ATTACK")] == 2000


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 997])
def test_split_is_the_hash_order(spark, n):
    df = spark.range(n).withColumn("c", F.when(F.col("id") % 3 == 0, "a").otherwise(F.when(F.col("id") % 3 == 1, "b")))
    got = {r["id"]: (r["c"], r["split"]) for r in sampling.stratified_split(df, "c", "id", RATIOS, 7).collect()}
    assert len(got) == n  # also rows whose class is null
    for c in ("a", "b", None):
        ids = sorted((i for i, (k, _) in got.items() if k == c), key=lambda i: (key(i, 7), i))
        cuts = [(len(ids) * p + 500) // 1000 for p in (800, 900)]
        want = ["train"] * cuts[0] + ["val"] * (cuts[1] - cuts[0]) + ["test"] * (len(ids) - cuts[1])
        assert [got[i][1] for i in ids] == want


def test_split_evaluates_its_rows_once(spark):
    """However many passes find the cuts, and however often the result is read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(i):
        seen.add(1)
        return "ab"[i % 2]

    split = sampling.stratified_split(spark.range(200).withColumn("c", label("id")), "c", "id", RATIOS)
    assert split.where("split = 'train'").count() == 160 and split.where("split = 'test'").count() == 20
    assert seen.value == 200


def test_sample(spark):
    df = spark.range(1000)
    got = {r["id"] for r in sampling.sample_rows(df, 50, "id").collect()}
    assert got == set(sorted(range(1000), key=lambda i: (key(i, 42), i))[:50])
    assert sampling.sample_rows(df, 5000, "id").count() == 1000


def test_downsample_keeps_all_others(spark):
    df = spark.range(20000).withColumn("unified_label", F.when(F.col("id") % 10 == 0, "BOTNET").otherwise("BENIGN"))
    n = {r[0]: r["count"] for r in sampling.downsample_majority(df, "id", target=3000).groupBy("unified_label").count().collect()}
    assert n["BOTNET"] == 2000 and abs(n["BENIGN"] - 3000) < 200
    assert sampling.downsample_majority(df, "id", target=10**9).count() == 20000


def test_write_splits(spark):
    df = spark.range(100).withColumn("unified_label", F.lit("A"))
    path = scratch_path(spark, "s")
    m = write_splits(sampling.stratified_split(df, "unified_label", "id", RATIOS), path, seed=42, ratios=RATIOS)
    assert {r["split"]: r["rows"] for r in m.collect()} == {"train": 80, "val": 10, "test": 10}
    record = read_manifest(spark, path).first()
    assert record["random_seed"] == "42" and record["ratios"] == RATIOS
    assert record["row_counts"] == {"total": 100, "train": 80, "val": 10, "test": 10}
    assert record["class_distribution_full_pct"] == {"A": 100.0}
    assert {k: spark.read.parquet(v).count() for k, v in record["output_files"].items()} == {"train": 80, "val": 10, "test": 10}
    assert spark.read.parquet(path).count() == 100
    assert write_splits(df.withColumn("split", F.lit("x")).where("id < 0"), scratch_path(spark, "e")).count() == 0
