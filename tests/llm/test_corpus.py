"""Operators over documents, vectors and pages against brute force, with odd rows."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowtide.llm import classifier, html_text, license_scan, near_dedup, packing, robust_outliers, suffix_dedup, topk_search
from flowtide.llm.components import connected_components

SF = "/root/testdata/sf0.001"
# Columns that clash with the operators' own names ride along.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score string, kept string, h long"
ODD = [None, "", " \n\t ", "One", "one two three", "!!! ###", "a " * 4000, "x" * 3000, "é" * 150 + " " + "é" * 150, "licensed under the Apache License, Version 2.0.", "Released\nunder the MIT License by CC BY-NC 4.0"]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}", 0, 1, "x", "y", 2) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    real = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect() for r in [(r.text,)]]
    long = real[3].split(" ")
    near = [" ".join([*long[:40], "changed", *long[41:]]), " ".join(long[2:])]
    return ODD + real + near + real[:6] + [real[5], "prefix " + real[7]]


@pytest.fixture(scope="module")
def odd_docs(spark, texts):
    ids = list(range(len(texts)))
    ids[20] = None
    df = docs_of(spark, texts, ids)
    return df.unionByName(df.filter("doc_id = 30"))


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_match_brute_force(spark, texts, odd_docs, n):
    sets = brute_sets(texts, n)
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if 20 not in (a, b) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * u:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    want = sorted([(i, len(sets[i]), label[i], label[i] == i) for i in range(len(texts)) if i != 20] + [(30, len(sets[30]), label[30], label[30] == 30)])
    got = near_dedup.components(odd_docs, n).collect()
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == want
    assert [tuple(r)[2:4] for r in got if r.doc_id is None] == [(None, True)]
    if n == 5:
        left = near_dedup.deduplicated(odd_docs)
        assert left.columns == odd_docs.columns
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({i for i, _, _, k in want if k})


def test_cross_component_links_are_found(spark):
    """Many versions of one text, each close to a few others only: a star cannot join them all."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    versions = []
    for _ in range(60):
        base = versions[rng.integers(len(versions))] if versions else words
        v = list(base)
        for at in rng.integers(0, 300, 4):
            v[at] = f"z{rng.integers(10**6)}"
        versions.append(v)
    texts = [" ".join(v) for v in versions]
    sets = brute_sets(texts, 5)
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    got = {r.doc_id: r.component_id for r in near_dedup.components(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 29), (31, 30), (40, 40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 29: 29, 30: 29, 31: 29}


def test_repeated_strings_match_brute_force(spark, texts, odd_docs):
    got = {}
    for r in suffix_dedup.deduplicate(odd_docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:5])
    seen, want_text = set(), {}
    for i, t in enumerate(texts):
        d = (t or "").encode()
        cov = bytearray(len(d))
        if i == 20:
            assert got[None] == [(len(d), 0, 0, hashlib.sha256(d).hexdigest())]
            continue
        for s in range(len(d) - 99):
            w = d[s : s + 100]
            if w in seen:
                cov[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(d, cov) if not c)
        want_text[i] = (kept, sum(cov))
        want = (len(d), sum(cov), len(bytes(cov).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
        assert got[i] == [want] * (2 if i == 30 else 1), i
    rest = {r.doc_id: r.text for r in suffix_dedup.rewritten(odd_docs).collect()}
    for i, (kept, removed) in want_text.items():
        if removed and not kept:
            assert i not in rest
        else:
            assert rest[i] == (kept.decode("utf-8", "ignore") if removed else texts[i])


def local_spans(texts, frequent=()):
    """The steps of covered_spans without Spark, so that their constants can be changed."""
    import zstandard

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(range(len(texts))), pa.int64()), "text": pa.array(texts, pa.string())})
    rows = [tuple(r.values()) for out in suffix_dedup._Places(frequent)([batch]) for r in out.to_pylist()]
    by_task = {}
    for r in rows:
        by_task.setdefault((hash((r[0], r[1])) % 3), []).append(r)
    names, shared = [x.split()[0] for x in suffix_dedup.PLACES.split(", ")], []
    for task in by_task.values():
        task.sort()
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*task[i : i + 7])], names=names) for i in range(0, len(task), 7)]
        shared += [r for out in suffix_dedup._Shared(frequent)(parts) for r in out.to_pylist()]
    covered = {i: set() for i in range(len(texts))}

    def cover(doc, s, e):
        covered[doc].update(range(s, e))

    press, wanted = zstandard.ZstdCompressor(), {}
    for r in shared:
        start = (r["packed"] >> 16) - (r["packed"] >> 8 & 255)
        if r["kind"]:
            wanted.setdefault((r["doc_id"], r["k1"]), []).append(r)
        else:
            cover(r["doc_id"], start, start + (r["packed"] & 255) + 100)
    contexts = sorted(suffix_dedup._Contexts()([(d, k, press.compress(texts[d].encode()), w) for (d, k), w in wanted.items()]))
    for doc, _, s, e in suffix_dedup._Repeats()(contexts):
        cover(doc, s, e)
    return covered, len(contexts)


@pytest.mark.parametrize("held, expand, frequent", [(1 << 17, 1 << 18, False), (4, 1 << 18, False), (1 << 17, 3, False), (4, 3, True)])
def test_frequent_hashes_and_large_groups_give_the_same(texts, monkeypatch, held, expand, frequent):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "EXPAND", expand)
    rng = np.random.default_rng(8)
    phrase = "the very same sixty bytes long phrase stands in every one here "
    some = [t for t in texts[:60] if t] + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + phrase + " ".join(rng.choice(["one", "two", "three"], 30)) for _ in range(40)]
    some += [some[0], "ab" * 400, "ab" * 90, "x" + "ab" * 100]
    hot = {int(h) for t in some for h in suffix_dedup.anchors(t.encode())[3].view(np.int64)} if frequent else ()
    got, _ = local_spans(some, hot)
    seen = set()
    for i, t in enumerate(some):
        d, want = t.encode(), set()
        for s in range(len(d) - 99):
            if d[s : s + 100] in seen:
                want.update(range(s, s + 100))
            seen.add(d[s : s + 100])
        assert got[i] == want, i


def test_later_rows_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cols = [rng.integers(0, 3, rng.integers(0, 12)) for _ in range(1)]
        n = len(cols[0])
        h, c2, doc, k1, packed = (rng.integers(0, 2, n) for _ in range(5))
        rows = list(zip(cols[0].tolist(), h.tolist(), c2.tolist(), doc.tolist(), k1.tolist(), packed.tolist()))
        want = {i for i, r in enumerate(rows) if any(x[:3] == r[:3] and x[3:] < r[3:] for x in rows)}
        assert set(suffix_dedup.later_rows(h, cols[0], c2, doc, k1, packed).tolist()) == want


def test_few_contexts_go_on(texts):
    """Contexts that share an anchor but no side stay behind."""
    rng = np.random.default_rng(9)
    some = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 40)) + " sixteen bytes!! " + " ".join(rng.choice(["one", "two", "three", "four", "five"], 40)) for _ in range(50)]
    places = sum(len(suffix_dedup.anchors(t.encode())[0]) for t in some)
    assert local_spans(some)[1] < places / 10


def test_sort_strings():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2, (3000, 7), dtype=np.uint64)
    words[1000:1500] = words[0]
    order, cls = suffix_dedup.sort_strings(words)
    rows = [tuple(r) for r in words[order]]
    assert sorted(order) == list(range(3000))
    assert all((rows[i] == rows[i + 1]) == (cls[i] == cls[i + 1]) for i in range(2999))
    assert len(set(rows)) == cls[-1] + 1


def test_license_scan_matches_brute_force(spark, texts, odd_docs):
    got = {r.doc_id: r for r in license_scan.scan(odd_docs).collect()}
    for i, t in enumerate(texts):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        base = [(k, lab) for p, lab in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        labels, score = {x for _, x in base}, 1.0 if base else 0.0
        coded = [w.encode() for w in words]
        for lab, s, window in license_scan.template_sets():
            if 10 * len(s.intersection(coded)) >= 9 * len(s):  # no block holds more than the text
                common = max(len(s.intersection(coded[a : a + window])) for a in range(max(len(coded) - window, 0) + 1))
                if 10 * common >= 9 * len(s):
                    labels.add(lab)
                    score = max(score, common / len(s))
        r = got[i if i != 20 else None]
        starts = [k for k, _ in base]
        assert tuple(r)[1:] == (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def test_license_blocks_cross_lines_and_stay_together():
    import random
    import textwrap

    sets = license_scan.template_sets()
    scan = license_scan._Scan(license_scan.Index(sets, {}))
    whole = {label: t for label, t in license_scan.TEMPLATES}  # the last of a label is its longest
    for label in ("mit", "isc", "bsd", "apache", "gpl", "zlib"):
        text = " ".join(whole[label].split())
        for form in (text, "\n".join(textwrap.wrap(text, 78)), "\n".join(" * " + x for x in textwrap.wrap(text, 40)), "before " * 500 + text + " after" * 500):
            (row,) = scan([(1, form)])
            assert label in row[6].split(",") and row[7] == 1.0, (label, row)
    for sentence in ("Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions\nare met",
                     "Permission to use, copy, modify, and distribute\nthis software for any purpose with or without fee is hereby granted"):
        assert next(scan([(1, sentence)]))[6] in ("bsd", "isc")
    rng = random.Random(7)
    scattered = whole["mit"].split() + [f"w{i}" for i in range(30000)]
    rng.shuffle(scattered)
    row = next(scan([(1, " ".join(scattered))]))
    assert row[6] == row[5] and row[7] == (1.0 if row[2] else 0.0)
    start = time.process_time()
    next(scan([(1, "mit license noninfringement merchantability gnu " * 200_000)]))
    assert time.process_time() - start < 60


def test_license_sliding_blocks_match_brute_force():
    import random

    rng = random.Random(3)
    templates = [("x", "a b c d e f g h i j"), ("y", "a a b k l"), ("z", "m")]
    sets = license_scan.template_sets(templates)
    index = license_scan.Index(sets, {c: rng.randrange(9) for c in "abcdefghijklm"})
    for _ in range(400):
        words = [rng.choice("abcdefghijklmnopq").encode() for _ in range(rng.randrange(60))]
        want = {}
        for lab, s, window in sets:
            common = max(len(s.intersection(words[a : a + window])) for a in range(max(len(words) - window, 0) + 1))
            if 10 * common >= 9 * len(s):
                want[lab] = common / len(s)
        assert dict(index.matches(words)) == want


def test_statistics_and_rules(spark, texts, odd_docs):
    rows = robust_outliers.judge(odd_docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[20 if r.doc_id is None else r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        rep = len({x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_outliers_are_native_and_found(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(rng.integers(60, 300))) for _ in range(300)]
    junk = [" ".join(w + "###" for w in clean[k].split()) for k in range(12)]
    docs = docs_of(spark, clean + junk).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    out = robust_outliers.judge(docs)
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    verdict = {r.doc_id: r.kept for r in out.collect()}
    assert all(verdict[i] for i in range(300)) and not any(verdict[300 + k] for k in range(12))
    kept = robust_outliers.accepted(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(300))


def _plain_texts(n, seed):
    rng = np.random.default_rng(seed)
    text = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(k))
    return text, [text(int(np.exp(rng.normal(5.0, 0.3)))) for _ in range(n)]


def _planted(text):
    """One text per statistic that is far off in it alone."""
    passage = text(14)
    lines = [text(4) for _ in range(20)]
    return {
        "words": text(4000), "length": " ".join(w + w for w in text(150).split()), "symbols": text(147) + " " + "# % & " * 9,
        "lines": "\n".join(lines + lines[::-1]), "repeats": " ".join([passage, text(35), passage, text(35)])}


def test_each_statistic_alone_rejects(spark):
    text, clean = _plain_texts(400, 3)
    planted = _planted(text)
    docs = docs_of(spark, clean + list(planted.values())).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    rows = {r.doc_id: r for r in robust_outliers.judge(docs).collect()}
    assert {k: (rows[400 + i].base_failed, rows[400 + i].kept) for i, k in enumerate(planted)} == {k: (False, False) for k in planted}
    assert sum(not rows[i].kept for i in range(400)) <= 4


def test_junk_below_half_of_a_group_is_rejected(spark):
    for share, seed in ((0.3, 5), (0.4, 6)):
        text, clean = _plain_texts(400, seed)
        n = int(400 * share)
        docs = docs_of(spark, [" ".join(w + "##" for w in x.split()) for x in clean[:n]] + clean[n:]).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
        kept = {r.doc_id: r.kept for r in robust_outliers.judge(docs).collect()}
        assert not any(kept[i] for i in range(n)) and sum(not kept[i] for i in range(n, 400)) <= 4


def _least_determinant(x, starts, rng):
    """Least log determinant (floored pivots, consistent scale) by concentration from random starts, and its mean."""
    h, best = -(-len(x) // 2), (np.inf, None)
    factor = robust_outliers.consistency(robust_outliers.SHARE)

    def estimate(rows):
        m, c = rows.mean(0), factor * np.cov(rows.T, bias=True)
        low = np.zeros_like(c)
        for j in range(5):
            for i in range(j, 5):
                v = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, robust_outliers.FLOOR[i] ** 2)) if i == j else v / low[j, j]
        return m, low, 2 * np.log(np.diag(low)).sum()

    for _ in range(starts):
        m, low, ld = estimate(x[rng.choice(len(x), 6, replace=False)])
        while True:
            d = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
            m2, low2, new = estimate(x[np.argsort(d, kind="stable")[:h]])
            m, low = m2, low2
            if not new < ld - 1e-9 and np.isfinite(ld):
                break
            ld = new
        best = min(best, (new, tuple(m)))
    return best


def test_least_determinant_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(5, 5))
    data = {"clean": rng.normal(size=(300, 5)) @ mix, "junk": np.vstack([rng.normal(size=(180, 5)) @ mix, rng.normal(size=(120, 5)) * 0.7 + 25.0])}
    rows = [("en", k, *map(float, v)) for k, x in data.items() for v in x]
    stats = spark.createDataFrame(rows, "g_lang string, g_source string, " + ", ".join(f"{z} double" for z in robust_outliers.VECTOR))
    got = {(r.e_level, r.e_source): r for r in robust_outliers.concentrated(stats, stats.select("g_lang", "g_source").distinct()).collect()}
    assert set(got) == {(2, "clean"), (2, "junk"), (1, ""), (0, "")}
    for k, x in data.items():
        ld, mean = _least_determinant(x, 200, rng)
        assert got[2, k].ld <= ld + 0.25, (k, got[2, k].ld, ld)
        assert np.abs(np.array([got[2, k][f"m{i}"] for i in range(5)]) - mean).max() < 0.6 * np.abs(mix).sum(0).max() ** 0.5


def test_small_groups_are_judged_too(spark):
    text, clean = _plain_texts(400, 3)
    junk = " ".join(w + "##" for w in text(150).split())
    groups = [("en", f"s{k % 3}") for k in range(400)] + [("en", "rare"), ("xx", "alone"), (None, None)]
    docs = docs_of(spark, [*clean, junk, junk, junk]).select("doc_id", "text")
    keys = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "doc_id long, lang string, source string")
    rows = {r.doc_id: r for r in robust_outliers.judge(docs.join(keys, "doc_id")).collect()}
    assert not any(rows[400 + k].kept or rows[400 + k].base_failed for k in range(3))
    assert all(r.distance is not None for r in rows.values())
    few = docs.join(keys, "doc_id").filter("doc_id % 10 = 0 OR doc_id = 401")
    small = {r.doc_id: r.kept for r in robust_outliers.judge(few).collect()}
    assert len(small) == 42 and not small[401] and sum(small.values()) >= 39


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.score(docs, classifier.fit(docs, labels)).join(labels.filter("quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.8


def test_classifier_odd_rows(spark, odd_docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = classifier.score(odd_docs, classifier.fit(odd_docs, none)).collect()
    assert len(rows) == len(texts) + 1 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    some = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(odd_docs, some)
    assert all(0 <= r.score <= 1 for r in classifier.score(odd_docs, model).collect())
    assert classifier.accepted(odd_docs, model).columns == odd_docs.columns


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "RANGE_ROWS", 64)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], "x") for i in range(300)]
    rows += [(400, None, "x"), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (500, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (550, [1.0, 2.0], "x"), (551, [0.5, -3.0], "x"), (600, [], "x"), (50, rows[50][1], "x")]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = sorted(map(tuple, topk_search.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect()))
    good = {i: np.floor(np.array(e) * 256).astype(int) for i, e, _ in rows[:300] + rows[304:307]}
    want = []
    for q in (x for x in good if x % 50 == 0):
        best = sorted((-int(good[q] @ c), i) for i, c in good.items() if i != q and len(c) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_pages(spark):
    page = (
        '<html><head><title>Site</title><style>p{}</style></head><body class="with-sidebar"><header><a href="/">Home</a> Big site name</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>'
        '<div id="cookie-notice">We use cookies to make this site work for all of you.</div><article><header><h1>Real   title</h1><p class="byline">By someone</p></header><p>First &amp; best<br>line with <b>bold</b>text.'
        '<p>Short.</p><aside>Look at this advert over here</aside><script>var t="</p>";</script><!-- no --><ul><li>Point one</li><li>Point <a href="x">two</a></li></ul></article>'
        '<section class="comments"><p>I think that this is a wonderful article about everything there is in the world.</p></section><form>Your name <input></form><footer>&copy; me &middot; all</footer>')
    bare = "<div><a>Home</a></div><div><a>News</a></div><h2>A heading of the text</h2><div>" + "Plain words of an article without any marks. " * 6 + "</div><div>" + "More of it follows here, long enough to be read. " * 5 + "</div><div><a>Next</a> <a>Last</a></div>"
    rows = [(1, "u", page, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<article>cut &am", 9), (5, "u", bare, 9), (5, "u", bare, 9), (None, "u", "<nav>x</nav>", 9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == 7
    assert by_id[1].text == "Real title First & best line with boldtext. Short. Point one Point two"
    assert by_id[2].text == by_id[3].text == by_id[None].text == "" and by_id[4].text == "cut &am"
    assert by_id[5].text.startswith("A heading of the text Plain words") and by_id[5].text.endswith("to be read.")
    assert all(r.n_chars == len(r.text) for r in got)


def used(tree):
    return set() if len(tree) == 1 else {html_text.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_html_frames_mark_their_own_content_only():
    tree, prose = html_text.trained_tree(), "Plain words of an article. " * 8
    prose = prose.strip()
    assert {"links_after", "words_before"} <= used(tree) or {"links_before", "words_before"} <= used(tree)
    whole = {
        "<div class='layout has-sidebar'><main><p>{}</p></main></div>", "<form action=x><main><p>{}</p></main></form>", "<form><article><p>{}</p></article></form>",
        "<div class='no-header with-nav'><p>{}</p></div>", "<div class='sidebar-layout'><main><p>{}</p></main></div>", "<main><p class='notice-free'>{}</p></main>",
        "<main><p>{} <span class='share'>Tweet</span></p></main>", "<main><p><span class='ad'>Buy now</span> {}</p></main>", "<div id='header'><article><p>{}</p></article></div>",
        "<main><p>{}</p><p class='social'><a href='x'>Tweet</a></p></main>", "<main><p>{}</p><p class='advert'>" + prose + "</p></main>",
        "<article><p>{}</p><div class='comments'><article><p>" + prose + "</p></article></div></article>", "<main><p>{}</p></main><aside><article><p>" + prose + "</p></article></aside>",
    }
    for page in whole:
        assert html_text.main_text(page.format(prose), tree) == prose, page
    three = "<main><p>{0}</p><p class='notice-free social'>{0}</p><p>{0}</p></main>".format(prose)
    assert html_text.main_text(three, tree) == " ".join([prose] * 3)
    assert html_text.main_text("<aside><article><p>" + prose + "</p></article></aside>", tree) == ""


def test_html_of_several_megabytes_takes_linear_time():
    tree, spent = html_text.trained_tree(), []
    for k in (50_000, 400_000):
        start = time.process_time()
        html_text.main_text("<b><article>" + "<i>a</b>" * k, tree)
        spent.append(time.process_time() - start)
    assert spent[1] < 30 * max(spent[0], 0.05)
    big = "<article>" + ("<p>" + "word " * 100 + "</p>") * 10_000 + "</article>"
    assert len(html_text.main_text(big, tree).split()) == 1_000_000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for out in (near_dedup.components(docs), suffix_dedup.deduplicate(docs), license_scan.scan(docs), robust_outliers.judge(docs), suffix_dedup.rewritten(docs), near_dedup.deduplicated(docs), robust_outliers.accepted(docs)):
        assert out.collect() == []
    v = topk_search.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search.top_k(v, v, 5).collect() == []
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.columns == names, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    sets = brute_sets([r.text for r in docs.collect()], 5)
    assert len(sets) > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in pieces if r.piece == 0) > 0 and packing.CAPACITY >= max(r.length for r in pieces)
