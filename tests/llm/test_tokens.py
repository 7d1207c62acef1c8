"""Token counts, packing and chunk BPE against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowtide.llm import chunk_bpe, packing, token_counts

ODD = [
    None, "", " ", "a", "don't  stop now\n\tÀ É", "<|endoftext|> x <|startoftext|>y", "x" * 5000, "日本語 " * 700, "ΑΣ ΣΑΣ İstanbul ŉ ſ", "é école",
    "The quick brown fox. " * 400, "The quick brown fox. " * 400, "\x1c\x1d a\x0bb\x0c", "a\r\n!!'s ''s 'LL 12 34٣", "#$%" * 900, "éà" * 3000,
]
SCHEMA = "doc_id long, text string, n_tokens string, length string, sequence_id int"


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "x", "y", 7) for i, t in enumerate(texts)], SCHEMA)


def mixed(spark):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return ODD + real + real[:20]


def byte_ids(text):
    t = Tokenizer.from_file(token_counts.tokens.default_paths()[0])
    return t.encode(text or "", add_special_tokens=False).ids


def test_lengths_and_suffix_sums_match_brute_force(spark):
    texts = mixed(spark)
    lengths = [len(byte_ids(t)) for t in texts]
    got = token_counts.token_counts(docs_of(spark, texts)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(lengths))
    for r in got:
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.n_tokens)
        assert r.docs_to == sum(n <= r.n_tokens for n in lengths)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    limits = [0, 1, 7, 100, 2048, 10**6]
    at = {r.limit: r for r in token_counts.at_limits(token_counts.token_counts(docs_of(spark, texts)), limits).collect()}
    for limit in limits:
        assert at[limit].truncated_tokens == sum(min(n, limit) for n in lengths)
        assert at[limit].docs_over == sum(n > limit for n in lengths)


def test_no_documents(spark):
    empty = docs_of(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty).collect() == []
    assert packing.pack(empty).collect() == []
    assert chunk_bpe.by_document(empty, chunk_bpe.encoded_texts(empty, digests=True)).collect() == []


def test_packing_is_whole_and_gapless(spark):
    texts = mixed(spark)
    rows = packing.pack(docs_of(spark, texts)).collect()
    by_seq = {}
    for r in rows:
        assert 0 < r.length <= 2048
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*byte_ids(t), 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(None if i == 3 else i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    tokens = sum(r.length for r in rows)
    assert len(by_seq) <= 1.02 * -(-tokens // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 500) if seed else np.full(300, 60)
    counts = {int(n): int((lengths == n).sum()) for n in set(lengths.tolist())}
    made = {}
    for times, parts in packing.plan(counts, 100):
        assert sum(parts) <= 100 and times > 0
        for n in parts:
            made[n] = made.get(n, 0) + times
    assert made == counts
    used = {}
    for n, lo, hi, _, _ in packing.places(packing.plan(counts, 100)):
        used.setdefault(n, []).append((lo, hi))
    for n, spans in used.items():
        assert sorted(spans)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:])) and sorted(spans)[-1][1] == counts[n]


def test_configurations_reach_a_known_optimum():
    # 60 + 40 fills a sequence of 100; the optimum pairs them.
    classes = packing.plan({60: 50, 40: 50}, 100)
    assert sum(times for times, _ in classes) == 50


def test_chunk_bpe_equals_the_library(spark):
    texts = mixed(spark)
    t = Tokenizer.from_file(chunk_bpe.default_path())
    want = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((None if i == 3 else i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    docs = docs_of(spark, texts)
    got = chunk_bpe.by_document(docs, chunk_bpe.encoded_texts(docs, digests=True)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    whole = chunk_bpe.by_document(docs, chunk_bpe.encoded_texts(docs)).filter("doc_id = 5").collect()[0]
    assert np.frombuffer(whole.ids, dtype="<u4").tolist() == t.encode(texts[5], add_special_tokens=False).ids
    assert whole.decoded == t.decode(t.encode(texts[5], add_special_tokens=False).ids, skip_special_tokens=False)


def test_shared_passages_give_equal_chunks():
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(3000))
    a, b = ("start " + passage).encode(), ("another beginning here " + passage + " end").encode()
    bodies = [{d[s:e] for _, s, e, _ in chunk_bpe.chunk_parts(d) if e > s} for d in (a, b)]
    assert len(bodies[0] & bodies[1]) >= 0.7 * min(map(len, bodies))
    for d in (a, b):
        parts = chunk_bpe.chunk_parts(d)
        assert parts[0][0] == 0 and parts[-1][3] == len(d) and all(x[3] == y[0] for x, y in zip(parts, parts[1:]))


def test_joins_that_disagree_are_extended(spark):
    """A tokenizer that joins blanks to the words after them: no body's ends agree where a word follows."""
    path = token_counts.tokens.default_paths()[0]
    t = Tokenizer.from_file(path)
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(1500))
    texts = [*ODD, "start " + passage, "another beginning here " + passage + " end", passage + "\n\n" + passage]
    docs = docs_of(spark, texts)
    rows = chunk_bpe.by_document(docs, chunk_bpe.encoded_texts(docs, path)).collect()
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    pairs = [(None if i == 3 else i, np.array(ids, dtype="<u4").tobytes(), t.decode(ids, skip_special_tokens=False)) for i, ids in enumerate(want)]
    assert sorted(map(repr, pairs)) == sorted(repr((r.doc_id, bytes(r.ids), r.decoded)) for r in rows)
    tool = chunk_bpe.codec(path)
    assert not tool.agrees(b"one two", 4) and tool.agrees(b"one two", 3)


def test_shared_bodies_stand_among_own_ones(spark):
    path = chunk_bpe.default_path()
    t = Tokenizer.from_file(path)
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(1500))
    texts = ["start " + passage, "\u65e5\u672c \u03a3\u0391\u03a3 \u00a0x\x1cy <|endoftext|> " + passage + " \u0308e" + passage, passage + "\t" * 3000 + "\u00c9" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in chunk_bpe.by_document(docs, chunk_bpe.encoded_texts(docs)).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
