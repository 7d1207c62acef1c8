"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the hashes of its different word shingles.  ``SYMBOLS``
minima, cut to 16 bits each, are its signature.  Texts with a similarity of 0.8
differ in 13 of 64 symbols on average; the join finds every pair that differs in
at most ``DISTANCE`` = 31 (more than five standard deviations above).  The
signature is split into 16 chunks of 4 symbols: if each chunk had two errors
there would be 32, so some chunk has at most one.  Each chunk enters the index
four times, once for every place the error may take.

Equal sets collapse to one node first.  In a bucket of the index every node is
compared with the smallest one only, which joins groups of near copies without
expanding them into pairs.  Buckets that still hold several components, cut into
block pairs where they are large, then compare members of different components
inside the tasks; only links come out.  No bucket is capped and no pair under
the distance is lost.  Every link is confirmed on the full sets; only pairs
inside one component are never looked at.

Defined results: words are parted by ASCII white space, A-Z is lower-cased; a
text shorter than a shingle has its whole sequence as one; a text without words
has an empty set and links to nothing; a null doc_id links to nothing, has a
null component and is kept; repeated rows share their component; rows of equal
doc_id and different text count as linked; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import LOWER, map_rows, mix, pick, prefix_hash, word_spans
from flowtide.llm.components import connected_components
from flowtide.session import cut

SYMBOLS = 64
CHUNK = 4
DISTANCE = SYMBOLS // CHUNK * 2 - 1
BLOCK = 1024
_A = np.random.default_rng(5).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted different 64-bit shingle hashes."""
    data = np.frombuffer((text or "").encode().translate(LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums, inverse = prefix_hash(data, 1)
    w = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit minima of a set."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _A).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype("<u2")


class _Signatures:
    def __init__(self, words):
        self.words = words

    def __call__(self, rows):
        for doc_id, text in rows:
            s = shingle_set(text, self.words)
            if doc_id is None or not len(s):
                yield doc_id, len(s), None, None, None
                continue
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            yield doc_id, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), signature(s).tobytes()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def _index(batches):
    """key, node: 64 index entries per node; 6 bits name the chunk and the free place, 48 hold three symbols."""
    for b in batches:
        sig = _matrix(b.column(1)).astype(np.uint64)
        keys = np.empty((len(sig), SYMBOLS), dtype=np.uint64)
        for chunk in range(SYMBOLS // CHUNK):
            part = sig[:, chunk * CHUNK : (chunk + 1) * CHUNK]
            for free in range(CHUNK):
                slot = chunk * CHUNK + free
                key = np.full(len(sig), slot, dtype=np.uint64)
                for k in range(CHUNK):
                    if k != free:
                        key = (key << np.uint64(16)) | part[:, k]
                keys[:, slot] = key
        nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[at : at + (1 << 16)].view(np.int64)), pa.array(nodes[at : at + (1 << 16)])], names=["key", "node"])


def index_entries(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "sig").mapInArrow(_index, "key long, node long")


def _sizes_fit(a, b):
    """The smaller set can still make up 80 % of the union."""
    return 100 * np.minimum(a, b) >= 80 * np.maximum(a, b)


def _near(batches):
    """Pairs (a, b, n_a, sig_a, n_b, sig_b) whose signatures and sizes allow a link."""
    for t in batches:
        ok = ((_matrix(t.column(3)) != _matrix(t.column(5))).sum(axis=1) <= DISTANCE) & _sizes_fit(t.column(2).to_numpy(), t.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], names=["a", "b"])


def _near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node", "n", "sig")
    a, b = n.toDF("a", "n_a", "sig_a"), n.toDF("b", "n_b", "sig_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sig_a", "n_b", "sig_b").mapInArrow(_near, "a long, b long")


class _Compressed:
    def __call__(self, rows):
        press = zstandard.ZstdCompressor(level=3)
        for doc_id, text in rows:
            yield doc_id, press.compress((text or "").encode())


class _Confirm:
    """Pairs whose full sets meet 100 * intersection >= 80 * union."""

    def __init__(self, words):
        self.words = words

    def __call__(self, rows):
        open_ = zstandard.ZstdDecompressor()
        last, left = None, None
        for a, b, za, zb in rows:
            if left is None or a != last:
                last, left = a, shingle_set(open_.decompress(za).decode(), self.words)
            right = shingle_set(open_.decompress(zb).decode(), self.words)
            common = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * common >= 80 * (len(left) + len(right) - common):
                yield a, b


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    with_b = pairs.join(texts.toDF("b", "zb"), "b")
    return map_rows(with_b.join(texts.toDF("a", "za"), "a").select("a", "b", "za", "zb"), "a long, b long", _Confirm(words))


def _groups(rows, width=3):
    """Consecutive rows of equal first ``width`` fields."""
    held, key = [], None
    for row in rows:
        if row[:width] != key:
            if held:
                yield held
            held, key = [], row[:width]
        held.append(row)
    if held:
        yield held


class _Group:
    """One block pair of a bucket: (key, i, j, blk, node, n, comp, sig[, z]) rows, smallest components first."""

    def __init__(self, rows):
        comp = np.array([r[6] for r in rows])
        _, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((comp, counts[inverse]))
        self.rows = [rows[i] for i in order]
        self.comp = comp[order]
        self.node, self.size, self.blk = (np.array([r[k] for r in self.rows]) for k in (4, 5, 3))
        self.sig = np.frombuffer(b"".join(r[7] for r in self.rows), dtype="<u2").reshape(-1, SYMBOLS)
        self.slot, self.one_block = rows[0][0] >> 48, rows[0][1] == rows[0][2]

    def pairs(self):
        """(row, partners): each pair of different components once, in the first bucket that it shares."""
        for r in range(len(self.node) - 1):
            if self.comp[r] == self.comp[-1]:
                return
            rest = slice(r + 1, None)
            ok = (self.comp[rest] != self.comp[r]) & _sizes_fit(self.size[rest], self.size[r])
            if not self.one_block:
                ok &= self.blk[rest] != self.blk[r]
            at = np.flatnonzero(ok) + r + 1
            if not len(at):
                continue
            same = self.sig[at] == self.sig[r]
            by_chunk = same.reshape(len(at), -1, CHUNK)
            chunk = (by_chunk.sum(axis=2) >= CHUNK - 1).argmax(axis=1)
            part = by_chunk[np.arange(len(at)), chunk]
            first = chunk * CHUNK + np.where(part.all(axis=1), 0, (~part).argmax(axis=1))
            at = at[(first == self.slot) & (SYMBOLS - same.sum(axis=1) <= DISTANCE)]
            if len(at):
                yield r, at


def _needed(rows):
    """The rows of each group that some pair needs."""
    for held in _groups(rows):
        g, need = _Group(held), set()
        for r, at in g.pairs():
            need.add(r)
            need.update(at.tolist())
        yield from (g.rows[r][:5] for r in need)


class _Cross:
    """Links between components, by exact intersections of one row's set with the group's."""

    def __init__(self, words):
        self.words = words

    def __call__(self, rows):
        open_ = zstandard.ZstdDecompressor()
        for held in _groups(rows):
            if len(held) < 2:
                continue
            g = _Group(held)
            sets = [shingle_set(open_.decompress(r[8]).decode(), self.words) for r in g.rows]
            ends = np.cumsum([len(x) for x in sets])
            starts = ends - [len(x) for x in sets]
            hashes, places = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(len(hashes), dtype=np.int32)
            root = {c: c for c in set(g.comp.tolist())}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for r, at in g.pairs():
                mine = places[starts[r] : ends[r]]
                marked[mine] = 1
                common = np.add.reduceat(marked[places], starts)[at]
                marked[mine] = 0
                for x in at[100 * common >= 80 * (len(sets[r]) + (ends - starts)[at] - common)]:
                    a, b = find(int(g.comp[r])), find(int(g.comp[x]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield int(g.node[r]), int(g.node[x])


def _cross_links(entries: DataFrame, nodes: DataFrame, comps: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links that join components sharing a bucket.

    Buckets are cut into block pairs.  A first pass over signatures names the
    rows that have a pair to look at; only their texts move, and only links
    between parts not yet joined come out.
    """
    own = comps.toDF("c_node", "c_label")
    labelled = nodes.select("node", "n", "sig").join(own, F.col("node") == F.col("c_node"), "left").select(
        "node", "n", F.coalesce("c_label", "node").alias("comp"), "sig")
    keyed = entries.join(labelled.select("node", "comp"), "node")
    mixed = (
        keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
        .filter("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    rows = keyed.select("key", "node").join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node")

    def spread(df):
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    seen = spread(rows.join(labelled, "node").select("key", "i", "j", "blk", "node", "n", "comp", "sig"))
    needed = map_rows(seen, "key long, i int, j int, blk int, node long", _needed)
    packed = needed.join(labelled, "node").join(texts.toDF("t_node", "z"), F.col("node") == F.col("t_node"))
    return map_rows(spread(packed.select("key", "i", "j", "blk", "node", "n", "comp", "sig", "z")), "a long, b long", _Cross(words))


def components(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    base = cut(map_rows(pick(docs, "doc_id", "text"), "doc_id long, n_shingles long, d1 long, d2 long, sig binary", _Signatures(words)))
    nodes = cut(
        base.filter("d1 IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    )
    found = index_entries(nodes)
    leaders = found.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1").select("key", "a")
    # Entries of buckets with one node can never give a pair.
    entries = cut(found.join(leaders, "key").select("key", "a", "node"))
    stars = entries.filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    met = entries.select("node").distinct().select(F.col("node").alias("doc_id"))
    packed = map_rows(pick(docs, "doc_id", "text").filter("doc_id IS NOT NULL"), "doc_id long, z binary", _Compressed())
    texts = cut(packed.join(met, "doc_id"))
    links = cut(_confirmed(_near_pairs(stars, nodes), texts, words))
    comps = connected_components(links)
    more = cut(_cross_links(entries.select("key", "node"), nodes, comps, texts, words))
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = connected_components(links)
    named = base.filter("d1 IS NOT NULL").select("doc_id", "n_shingles", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    # Rows of one id with different texts are one document of the graph.
    several = named.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    if not several.isEmpty():
        same = named.join(several, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
        comps = connected_components(links.unionByName(same))
    linked = named.join(comps.toDF("c_node", "label"), F.col("node") == F.col("c_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    alone = base.filter("d1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents, all columns, of which one per component is kept.

    Repeated rows of a kept id leave one row; rows without an id all stay.
    """
    kept = components(docs, words).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
