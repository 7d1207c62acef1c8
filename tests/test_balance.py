"""Synthetic and interpolated rows: exact ranks, grids and correlations against numpy, spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators import balance
from flowtide.operators.ordering import rank_within

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for name, n in (("big", 4000), ("mid", 700), ("tiny", 3), ("one", 1)):
        a = rng.lognormal(size=n).round(2)
        for x, y in zip(a, a * 2 + rng.normal(size=n).round(1)):
            data.append((len(data), name, float(x), float(y), 5.0))
    return spark.createDataFrame(data, "id long, k string, a double, b double, c double").repartition(5).cache()


def column(df, name, c):
    return np.array([r[0] for r in df.where(F.col("k") == name).select(c).collect()])


def grid_of(x):
    return np.interp(np.arange(balance.GRID + 1) / balance.GRID, (np.arange(len(x)) + 0.5) / len(x), np.sort(x))


def test_ranks_and_grids_match_numpy(spark, rows):
    small = balance._small_classes(rows, "k", 10_000)
    work = rows.join(small, "k")
    ranks = balance.value_ranks(work, "k", COLS)
    grids = {(r["k"], r["_f"]): np.array(r["values"]) for r in balance.quantile_grids(ranks, "k").collect()}
    assert len(grids) == 12
    for (k, f), g in grids.items():
        x = column(rows, k, COLS[f])
        assert len(g) == balance.GRID + 1 and np.allclose(g, grid_of(x)), (k, f)
        got = sorted((r["_v"], r["_c"], r["_last"]) for r in ranks.where((F.col("k") == k) & (F.col("_f") == f)).collect())
        u, c = np.unique(x, return_counts=True)
        assert got == list(zip(u, c, np.cumsum(c)))


def test_correlations_match_numpy(rows):
    work = rows.join(balance._small_classes(rows, "k", 10_000), "k")
    ranks = balance.value_ranks(work, "k", COLS)
    got = {r["k"]: r for r in balance.score_correlations(work, ranks, "id", "k", COLS).collect()}
    z, p = balance._normal_grid()
    for k in ("big", "mid"):
        s = []
        for c in ("a", "b"):
            x = column(rows.orderBy("id"), k, c)
            rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
            s.append(np.interp((rank - 0.5) / len(x), p, z))
        assert got[k]["c_1_0"] == pytest.approx(np.corrcoef(s)[0, 1], abs=1e-9)


def test_synthetic_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(balance, "CHUNK", 500)
    new = balance.synthesize_minority(rows, "id", "k", COLS, target=3000).cache()
    assert {r["k"]: r["count"] for r in new.groupBy("k").count().collect()} == {"mid": 2300, "tiny": 2997, "one": 2999}
    assert new.select("id").distinct().count() == new.count() and new.where("id >= 0").count() == 0
    real, made = column(rows, "mid", "a"), column(new, "mid", "a")
    assert made.min() >= real.min() and made.max() <= real.max()
    assert abs(np.median(made) - np.median(real)) < 0.1 * real.std()
    assert np.corrcoef(column(new.orderBy("id"), "mid", "a"), column(new.orderBy("id"), "mid", "b"))[0, 1] > 0.8
    assert set(column(new, "mid", "c")) == {5.0} and set(column(new, "one", "a")) == set(column(rows, "one", "a"))
    assert new.exceptAll(balance.synthesize_minority(rows, "id", "k", COLS, target=3000)).isEmpty()
    assert new.rdd.glom().map(len).filter(lambda n: n > 0).count() > 3  # many tasks share a class


def test_targets_above_a_million_are_no_limit(rows):
    tiny = rows.where("k = 'tiny'")
    new = balance.synthesize_minority(tiny, "id", "k", COLS, threshold=2_000_000, target=1_200_000)
    assert new.count() == 1_200_000 - 3
    added = balance.smote(tiny, "id", "k", COLS, target=1_050_000)
    assert added.count() == 1_050_000 - 3


def test_synthesis_of_odd_rows(spark, rows):
    odd = rows.unionAll(spark.createDataFrame([(10**6, None, 1.0, 1.0, 1.0), (10**6 + 1, "mid", None, 1.0, 1.0), (10**6 + 2, "mid", float("nan"), 1.0, 1.0)], rows.schema))
    got = {r["k"]: r["count"] for r in balance.synthesize_minority(odd, "id", "k", COLS, target=800).groupBy("k").count().collect()}
    assert got == {"mid": 100, "tiny": 797, "one": 799}
    assert balance.synthesize_minority(rows.where("id < 0"), "id", "k", COLS).collect() == []


def test_every_stage_changes_what_the_next_one_reads(spark):
    """Synthesised rows are interpolated and cleaned; interpolation has a target of its own."""
    rng = np.random.default_rng(7)
    sizes, data = {"BENIGN": 400, "BOTNET": 60, "WEB_ATTACK": 20}, []
    for centre, (name, n) in zip((0.0, 30.0, 60.0), sizes.items()):
        data += [(len(data) + i, *map(float, centre + x), name) for i, x in enumerate(rng.normal(size=(n, 12)))]
    rows = spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for c in S.GOLDEN12) + ", unified_label string")

    clean, report = balance.balance_dataset(rows, "id", majority_target=200, threshold=50, target=100, smote_target=140)
    found = {}
    for r in report.collect():
        found.setdefault(r["stage"], {})[r["unified_label"]] = r["rows"]
    down = found["downsampled"]["BENIGN"]
    assert 150 < down < 250 and found["input"] == sizes
    assert found["synthesized"] == {"BENIGN": down, "BOTNET": 60, "WEB_ATTACK": 100}
    assert found["smote"] == {"BENIGN": down, "BOTNET": 140, "WEB_ATTACK": 140}
    kept = {(r["unified_label"], r["origin"]): r["count"] for r in clean.groupBy("unified_label", "origin").count().collect()}
    assert kept["WEB_ATTACK", "copula"] == 80 and kept["WEB_ATTACK", "smote"] == 40 and kept["BOTNET", "smote"] == 80


def test_rank_within_groups(spark):
    rng = np.random.default_rng(1)
    data = [(i, f"g{min(2, int(rng.integers(0, 9)))}", float(rng.integers(0, 5))) for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string, v double")
    got = {r["id"]: r["n"] for r in rank_within(df, ["g"], ["v", "id"], "n").collect()}
    want = {}
    for g in ("g0", "g1", "g2"):
        want |= {i: n for n, (_, i) in enumerate(sorted((v, i) for i, k, v in data if k == g), start=1)}
    assert got == want
