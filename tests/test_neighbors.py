import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.operators import balance, neighbors


def brute(x, ids, k, y=None, yid=None, skip=True, group=None):
    y, yid = (x, ids) if y is None else (y, yid)
    out = {}
    for i, v in enumerate(x):
        d = np.zeros(len(y))
        for j in range(x.shape[1]):
            d += (v[j] - y[:, j]) ** 2
        c = [(d[m], yid[m]) for m in range(len(y)) if not (skip and yid[m] == ids[i]) and (group is None or group[m] == group[i])]
        out[ids[i]] = [m for _, m in sorted(c)[:k]]
    return out


def frame(spark, x, ids, extra=None):
    cols = [f"f{j}" for j in range(x.shape[1])]
    data = [(int(i), *[float(a) for a in v], *( [extra[n]] if extra is not None else [])) for n, (i, v) in enumerate(zip(ids, x))]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for c in cols) + (", g string" if extra is not None else "")), cols


def got(df, k, **kw):
    out = {}
    for r in neighbors.knn_join(df, kw.pop("cols"), k, "id", **kw).collect():
        out.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 20)
    monkeypatch.setattr(neighbors, "PROBES_PER_TASK", 15)
    monkeypatch.setattr(neighbors, "HOT_ROWS", 50)


def points(seed, n=300, lattice=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 3)).astype(float) if lattice else rng.lognormal(0, 2, (n, 3)) * [1, 100, 1e4]
    x[: n // 3] = x[0]                      # a third of all rows is one vector
    ids = rng.permutation(n * 5)[:n]
    return x, ids


@pytest.mark.parametrize("lattice", [False, True])
def test_exact_with_copies_ties_and_many_blocks(spark, tiny_blocks, lattice):
    x, ids = points(1, lattice=lattice)
    df, cols = frame(spark, x, ids)
    assert got(df, 4, cols=cols) == brute(x, ids, 4)


def test_box_tree_finds_the_near_boxes_and_visits_few():
    rng = np.random.default_rng(8)
    corner = np.sort(rng.uniform(0, 1000, 4096))
    lo = np.stack([corner, rng.uniform(0, 1, 4096)], axis=1)
    hi, group = lo + 0.5, np.repeat(["a", "b"], 2048)
    lo[5], hi[6] = np.nan, np.inf
    x = np.stack([rng.uniform(0, 1000, 300), rng.uniform(0, 1, 300)], axis=1)
    x[7] = np.inf
    bound, g = np.where(rng.random(300) < 0.02, np.inf, 0.3), rng.choice(["a", "b", "c"], 300)
    want = []
    for i, v in enumerate(x):
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(lo - v, v - hi), 0.0)
        want += [(i, b) for b in np.flatnonzero(((gap * gap).sum(axis=1) <= bound[i]) & (group == g[i]))]
    boxes = neighbors._Boxes(lo, hi, group)
    assert sorted(zip(*(a.tolist() for a in boxes.near(x, bound, g)))) == want
    # a tree of a hundred times the boxes is a few levels deeper, not a hundred times the work
    assert [len(level[0]) for level in boxes.levels] == [4096, 512, 64, 8]


@pytest.mark.parametrize("kind", ["spread", "ties", "outliers", "infinite"])
def test_region_search_is_exact(kind):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (900, 5)).astype(float) if kind == "ties" else rng.lognormal(0, 1, (900, 5)) * 1e4
    if kind == "outliers":
        x[::90] *= 1e9
    if kind == "infinite":
        x[::90, 2] = np.inf
    ids, block, q = rng.permutation(10_000)[:900] - 5_000, rng.integers(0, 6, 900), x[:200]
    asked, blocks = np.repeat(np.arange(200), 3), np.concatenate([rng.permutation(6)[:3] for _ in range(200)])
    with np.errstate(invalid="ignore"):
        d = np.zeros((200, 900))
        for j in range(5):
            d += (q[:, j, None] - x[None, :, j]) ** 2
    bound = np.where(np.arange(200) % 3 == 0, np.nanquantile(d, 0.01), np.inf)
    count, found, dist = neighbors._search_region(q, bound, asked, blocks, ids, x, block, 4)
    for i in range(200):
        near = [(d[i, m], ids[m]) for m in range(900) if block[m] in blocks[3 * i:3 * i + 3] and d[i, m] <= bound[i]]
        assert list(zip(dist[i, :count[i]], found[i, :count[i]])) == sorted(near)[:4]


def test_points_meet_a_region_once(spark, tiny_blocks, monkeypatch):
    """Wide vectors ask for every block; each goes to a region once and leaves with one list."""
    rows, probe = [], neighbors._probe
    monkeypatch.setattr(neighbors, "_probe", lambda asked, *a: rows.append(asked.count()) or probe(asked, *a))
    x = np.random.default_rng(10).normal(size=(400, 12))
    ids = np.arange(400)
    df, cols = frame(spark, x, ids)
    assert got(df, 3, cols=cols) == brute(x, ids, 3)
    assert rows == [400, 400]  # 20 blocks, one region


def test_within_groups_and_two_tables(spark, tiny_blocks):
    x, ids = points(2, 200)
    g = ["a" if i % 4 else "b" for i in range(len(ids))]
    df, cols = frame(spark, x, ids, g)
    assert got(df, 3, cols=cols, within="g") == brute(x, ids, 3, group=g)
    y, yid = points(3, 120)
    right, _ = frame(spark, y, yid)
    assert got(df, 3, cols=cols, right=right) == brute(x, ids, 3, y, yid, skip=False)


def test_fewer_rows_than_k(spark):
    x, ids = np.array([[0.0], [1.0], [5.0]]), [7, 8, 9]
    df, cols = frame(spark, x, ids)
    assert got(df, 5, cols=cols) == {7: [8, 9], 8: [7, 9], 9: [8, 7]}
    assert got(df.where("id = 7"), 5, cols=cols) == {}
    assert neighbors.knn_lists(df.where("id < 0"), cols, 2, "id").count() == 0


def test_enn_drops_mixed_neighbourhoods_but_not_the_smallest_class(spark):
    rows = [(i, float(i), "A") for i in range(10)] + [(20 + i, 100.0 + i, "B") for i in range(6)] + [(30, 4.5, "B"), (40, 104.5, "C")]
    df = spark.createDataFrame(rows, "id long, x double, unified_label string")
    left = {r["id"] for r in balance.enn_clean(df, "id", features=["x"]).collect()}
    ids = [r[0] for r in rows]
    near = brute(np.array([[r[1]] for r in rows]), ids, 3)
    cls = {r[0]: r[2] for r in rows}
    assert left == {i for i in ids if cls[i] == "C" or all(cls[n] == cls[i] for n in near[i])}
    assert 30 not in left and 40 in left


def test_smote_rows_lie_between_two_real_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *rng.normal(size=2).tolist(), "A" if i < 40 else "B") for i in range(60)] + [(99, 0.0, 0.0, "lonely")]
    df = spark.createDataFrame(rows, "id long, x double, y double, unified_label string")
    new = balance.smote(df, "id", features=["x", "y"], target=40, k=3).collect()
    at = {r[0]: r for r in rows}
    near = {c: brute(np.array([r[1:3] for r in rows if r[3] == c]), [r[0] for r in rows if r[3] == c], 3) for c in ("A", "B")}
    assert len(new) == 20 and {r["unified_label"] for r in new} == {"B"}
    assert len({r["id"] for r in new}) == 20 and all(r["id"] < 0 for r in new)
    for r in new:
        a, b = at[r["base_id"]], at[r["nn_id"]]
        assert r["nn_id"] in near["B"][r["base_id"]]
        assert np.isclose(r["x"], a[1] + r["u"] * (b[1] - a[1])) and np.isclose(r["y"], a[2] + r["u"] * (b[2] - a[2]))


def test_copula_keeps_marginals_and_correlation(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=800)
    rows = [(i, float(np.exp(v)), float(2 * v + rng.normal() * .3), 5.0, "small") for i, v in enumerate(a)] + [(10_000 + i, 0.0, 0.0, 0.0, "big") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, unified_label string")
    new = balance.synthesize_minority(df, "id", features=["x", "y", "z"], threshold=2500, target=2400).toPandas()
    assert len(new) == 1600 and set(new.unified_label) == {"small"} and new.id.is_unique and set(new.origin) == {"copula"}
    real = np.array([r[1:3] for r in rows[:800]])
    for q in (.1, .5, .9):
        assert abs(np.quantile(np.log(new.x), q) - np.quantile(np.log(real[:, 0]), q)) < .2
    assert np.corrcoef(np.log(new.x), new.y)[0, 1] > .9 and (new.z == 5.0).all()
    assert new.x.min() >= real[:, 0].min() and new.x.max() <= real[:, 0].max()
    again = balance.synthesize_minority(df.repartition(7), "id", features=["x", "y", "z"], threshold=2500, target=2400).toPandas()
    assert np.allclose(np.sort(again.x), np.sort(new.x))


# ---------------------------------------------------------------- approximate search
def recall(spark, df, k, **kw):
    exact = neighbors.knn_join(df, "v", k, "id", **kw).select("id", "nn_id")
    near = neighbors.knn_join(df, "v", k, "id", method="lsh", **kw).select("id", "nn_id")
    return exact.intersect(near).count() / exact.count()


def test_lsh_recall_on_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LSH_BUCKET", 128)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert recall(spark, df, 5) >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    def make(n):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 25, 32)) * 3
        x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, 32))
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(x), "g": [f"g{i % 2}" for i in range(n)]}))
    return make


def test_lsh_work_per_point_does_not_grow(spark, clustered, monkeypatch):
    """Recall holds and no bucket grows while the table becomes four times as large."""
    monkeypatch.setattr(neighbors, "LSH_TABLES", 8)
    monkeypatch.setattr(neighbors, "LSH_BUCKET", 64)
    for n in (1500, 6000):
        assert recall(spark, clustered(n), 5) >= 0.9
    sizes = []
    real = neighbors._nearest
    monkeypatch.setattr(neighbors, "_nearest", lambda *a: sizes.append(len(a[4])) or real(*a))
    x = np.random.default_rng(1).normal(size=(5000, 8))
    ids = np.arange(len(x))
    got = pd.concat(neighbors._bucket_pairs(ids, x, ids, x, 3, 128, 0))
    assert max(sizes) <= 128 and len(got) == 3 * len(x)  # an oversized bucket is parted until it fits


def test_lsh_falls_back_to_the_exact_search(spark, clustered, monkeypatch):
    """A rare group is spread over all buckets; its points still get their exact neighbours."""
    monkeypatch.setattr(neighbors, "LSH_TABLES", 2)
    monkeypatch.setattr(neighbors, "LSH_BUCKET", 64)
    df = clustered(1500).withColumn("g", F.when(F.col("id") % 300 == 0, "rare").otherwise("many"))
    rare = F.col("id") % 300 == 0
    exact = neighbors.knn_join(df, "v", 3, "id", within="g").where(rare)
    near = neighbors.knn_join(df, "v", 3, "id", within="g", method="lsh").where(rare)
    assert exact.count() == near.count() == 15 and exact.exceptAll(near).isEmpty()


def test_lsh_between_two_tables_and_odd_inputs(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbors, "LSH_TABLES", 8)
    monkeypatch.setattr(neighbors, "LSH_BUCKET", 64)
    monkeypatch.setattr(neighbors, "PROBES_PER_TASK", 20)
    df = clustered(1000)
    left, right = df.where("id < 300").drop("g"), df.where("id >= 300").drop("g")
    exact = neighbors.knn_join(left, "v", 4, "id", right=right).select("id", "nn_id")
    near = neighbors.knn_join(left, "v", 4, "id", right=right, method="lsh").select("id", "nn_id")
    assert near.count() == exact.count() and exact.intersect(near).count() >= 0.9 * exact.count()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert {r.id: r.nn_id for r in neighbors.knn_join(same, "v", 1, "id", method="lsh").collect()} == {0: 1, **dict.fromkeys(range(1, 9), 0)}
    assert neighbors.knn_join(same.where("id < 0"), "v", 1, "id", method="lsh").collect() == []
    with pytest.raises(ValueError):
        neighbors.knn_join(same, "v", 1, "id", method="hnsw")
