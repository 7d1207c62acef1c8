"""Spelling variants, source mixing and whitening against brute force, with odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowtide.llm import mixing, spelling, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, word string, n long, id long, size string, unit long, mark string, p long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, 2, "x", 3, "y", 4) for i, t, s in rows], SCHEMA)


# ---------------------------------------------------------------- spelling
def brute_counts(rows, least=7, often=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= often}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(counts, ratio=10):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in words:
        top = w
        while form[top]:
            top = form[top]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, top))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_of_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").limit(60).collect()]
    rows += [(None, "Aardvark aardvark AARDVARK Übermut übermut", None), (1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "abcdefgh×ijkl÷ " * 3, "b"),
             (5, ("z" * 40_000 + " ") * 2, "b"), (6, ("z" * 40_001 + " ") * 3 + "y" + "z" * 39_999 + " y" + "z" * 39_999, "c"), (7, "word " * 300_000, "c"), (7, "word " * 300_000, "c")]
    counts = brute_counts([r[:2] for r in rows])
    assert len(counts) > 200
    assert rows_of(spelling.spelling_variants(docs_of(spark, rows))) == sorted(brute_variants(counts))


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_variants_of_dense_words_over_any_blocks(spark, monkeypatch, blocks):
    """Few letters, so nearly every word has neighbours, ties and runs of equal letters."""
    rng = np.random.default_rng(blocks)
    counts = {"".join(rng.choice(list("abé"), rng.integers(1, 7))): int(10 ** rng.integers(0, 6)) for _ in range(250)}
    monkeypatch.setattr(spelling, "BLOCK_WORDS", max(1, len(counts) // blocks))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(words)) == sorted(brute_variants(counts))


def test_pair_rows_may_cross_batches(spark):
    counts = {f"abc{c}efg": 2 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows_of(spelling.variants(words)) == sorted(brute_variants(counts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_partial_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling._Count, "HELD", 2)
    got = spelling.word_counts(docs_of(spark, [(i, "abcdefg bcdefgh cdefghi", None) for i in range(9)])).collect()
    assert {r.word: r.n for r in got} == brute_counts([(i, "abcdefg bcdefgh cdefghi") for i in range(9)])


def test_variants_of_an_empty_table(spark):
    df = spelling.spelling_variants(docs_of(spark, []))
    assert df.collect() == [] and df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert spelling.spelling_variants(docs_of(spark, [(1, "", None), (None, None, None)])).collect() == []


# ---------------------------------------------------------------- mixing
def brute_seats(shares, total):
    out = dict.fromkeys(shares, 0)
    for _ in range(total):
        best = min((u for u in shares if shares[u] > 0), key=lambda u: (-shares[u] / (2 * out[u] + 1), u))
        out[best] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_seats_match_the_highest_quotients(spark, seed):
    rng = np.random.default_rng(seed)
    shares = {int(u): float(rng.choice([0, 1, 1, 3, 10, 500])) for u in range(1, 40)}
    total = int(rng.integers(0, 300))
    units = spark.createDataFrame([(u, s, total, u % 3) for u, s in shares.items()], "unit long, share double, total long, g long")
    assert {r.unit: r.seats for r in mixing.apportion(units, "total", "share", None).collect()} == brute_seats(shares, total)
    got = {r.unit: r.seats for r in mixing.apportion(units, "total", "share", "g").collect()}
    want = {}
    for g in range(3):
        want |= brute_seats({u: s for u, s in shares.items() if u % 3 == g}, total)
    assert got == want


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    words, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = words - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(spark, rows):
    df = mixing.mix(docs_of(spark, rows))
    assert df.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, df.collect()), key=repr)
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    assert sorted(((i, n) for (i, _, _), n in zip(rows, count)), key=repr) == sorted(((r[0], r[1]) for r in got), key=repr)
    sizes = Counter()
    for (_, _, s), n in zip(rows, count):
        sizes[s] += n
    target, source = brute_targets(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    for i, size, source_size, t, k in got:
        s = source[i]
        assert 0 <= k <= 3 * size and source_size == sizes[s] and t == pytest.approx(target[s], rel=1e-12)
        taken[s] += k
    least = min((t for t in target.values() if t > 0), default=0)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3), (s, taken[s], t, least)
    assert sorted(map(tuple, mixing.mix(docs_of(spark, rows[::-1])).collect()), key=repr) == got
    return taken, target


def test_mix_of_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_mix(spark, rows)


def test_mix_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 300)), "hot") for i in range(400)]
    rows += [(1000 + i, "a b\tc", "tiny") for i in range(5)] + [(1100, "x" * 10, "")] + [(1200 + i, "n o n e", None) for i in range(40)]
    rows += [(1300, None, "silent"), (1301, "", "silent"), (1302, "word " * 200_000, "long"), *[(1400, "same text here", "same")] * 30]
    taken, target = check_mix(spark, rows)
    assert taken["tiny"] == 3 * 15 == target["tiny"] and taken["silent"] == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    got = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_stays_in_the_jvm(spark):
    plan = mixing.mix(docs_of(spark, [(1, "a", "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan.replace("LogicalRDD", "").replace("ExistingRDD", "").replace("Scan ExistingRDD", ""))


# ---------------------------------------------------------------- whitening
def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, n long")


def brute_whitening(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.float32(v).astype(float)) for _, v in kept]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    z = (x - s / n) @ q[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), z, e[:k] / np.trace(v), kept


def check_whitening(spark, rows):
    n, away, z, explained, kept = brute_whitening(rows)
    df = whitening.whiten(vectors_of(spark, rows))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = df.collect()
    k = min(4, z.shape[1])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i, _ in kept for c in range(1, k + 1))
    by_id = {i: j for j, (i, _) in enumerate(kept)}
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        j, want = by_id[r.vec_id], z[by_id[r.vec_id], r.component - 1]
        sign.setdefault(r.component, np.sign(r.whitened * want))
        assert r.n == n and r.deviation == away[j]
        assert sign[r.component] * r.whitened == pytest.approx(want, abs=1e-7)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_whitening_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(spark, rows)


def test_whitening_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [9, 7, 5, 3, 2, 1] + 40]) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(100)] + [(600, None), (601, [float("nan")] * 6), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (603, [float("inf")] * 6)]
    rows += [(None, rows[1][1]), (5, rows[5][1]), (700, [-0.0] * 6)]
    check_whitening(spark, rows)


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []


def test_whitening_of_two_lengths_and_low_rank(spark):
    rows = [(i, [float(i), float(2 * i), 1.0]) for i in range(9)] + [(100 + i, [float(i % 3), float(i % 2)]) for i in range(6)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert Counter((r.vec_id < 100, r.component) for r in got) == {(True, 1): 9, (False, 1): 6, (False, 2): 6}
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_great_values(spark):
    rows = [(i, [float(2**40 + i * 2**20), float(2**60 * (-1) ** i)]) for i in range(8)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(8)) and all(r.deviation is None for r in got)
    assert max(r.identity_error for r in got) < 1e-6


def spectra():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(32, 32)))
    a = rng.normal(size=(200, 64))
    return [a.T @ a, np.eye(8), (q * np.r_[5, 5, 5, 5, 5, 1, np.ones(26) * 0.1]) @ q.T, (q * np.r_[5, 5 - 1e-9, 4, 4 - 1e-7, 4 - 2e-7, 1, np.ones(26) * 0.1]) @ q.T,
            (q * np.r_[1e6, 1e2, 1, 1e-3, np.zeros(28)]) @ q.T, (q * 2.0 ** -np.arange(32)) @ q.T, (q * np.linspace(1, 1.01, 32)) @ q.T, np.array([[2.0]])]


@pytest.mark.parametrize("case", range(8))
def test_components_match_the_dense_solver(case):
    v = spectra()[case]
    e, x = whitening.components(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(4, len(v))
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(v @ x - x * e).max() <= 1e-12 * want[0]
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


@pytest.mark.parametrize("case", range(8))
def test_inertia_counts(case):
    v = spectra()[case]
    e = np.linalg.eigvalsh(v)
    for s in np.unique(np.round(np.concatenate([e + 0.01 * e.max(), e - 0.01 * e.max()]), 3)) + 1e-4:
        assert whitening.inertia(v, s) == (e > s).sum()


def test_inertia_needs_two_by_two_pivots():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.inertia(np.zeros((3, 3)), 0.0) == 0
