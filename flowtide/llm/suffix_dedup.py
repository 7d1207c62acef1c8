"""Removal of repeated byte strings by suffix sorting (deep-shallow).

Every ``LENGTH``-byte string of a text has an anchor: the leftmost smallest hash
among its ``K``-byte strings.  Equal strings have equal anchors, so only texts
that share an anchor hash can share a string.  The bytes of all strings of one
anchor are its context.  Each text sends one short row per anchor to the hash:
digests of the context and of the anchor with ``SIDE`` bytes to its left and to
its right.  Rows of equal contexts stand side by side there, and all but the
earliest are covered whole.  A string that two different contexts share holds
``SIDE`` bytes on one side of the anchor at least, so only contexts that agree
on a side go on; few do.  They alone fetch their bytes and meet per side.  There
the strings are sorted as suffixes: a multikey sort over the first ``SHALLOW``
words of eight bytes, then blind tries over the groups that remain, whose nodes
look only at the first word in which their members differ.  Members of one leaf
are equal; all but the earliest are covered.

A hash's rows pass through a task in order and are not held.  A context that a
batch of texts holds twice goes there once.  Hashes that a
sample of the texts shows to be frequent are dealt over ``PARTS`` tasks by
context; their contexts all go on, which changes no result.  Strings of a large
group are sorted one anchor offset at a time.

Defined results: a null text counts as empty; texts below ``LENGTH`` bytes keep
all; a row without doc_id has no place in the order, keeps all its bytes and
covers none; rows equal in doc_id and text are one document and get one result
each; rows of one doc_id with different texts are ordered by a hash of the text;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import map_rows, mix, pick, prefix_hash
from flowtide.session import cut

LENGTH = 100
K = 16
SHALLOW = 3
WORDS = -(-LENGTH // 8)
SIDE = (LENGTH - K) // 2
EXPAND = 1 << 18        # strings sorted at a time; a larger group goes one offset at a time
HELD = 1 << 17          # rows of one hash that are filtered together; of more, all contexts go on
SAMPLE_TEXTS = 2_000    # texts looked at for frequent hashes
FREQUENT = 0.01         # share of the sample that makes a hash frequent
PARTS = 64
SEGMENT = 1 << 22


def _key(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, hash, context digest, second digest and sides) of each anchor.

    First and last start are those of the strings that the anchor stands for.
    The last value holds 32 bits of a second digest and 16 each of the left and
    the right side, 0 where the context does not reach that far.
    """
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3]
    for base in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        arr = np.frombuffer(data, dtype=np.uint8)[base : base + SEGMENT + LENGTH - 1]
        sums, inverse = prefix_hash(arr, 2)
        h = mix((sums[K:] - sums[:-K]) * inverse[: len(arr) - K + 1])
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, full = 1, LENGTH - K + 1
        while width * 2 <= full:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if full > width:
            low = np.minimum(low[: len(low) - (full - width)], low[full - width :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        place, end = at[first], last + LENGTH
        one, two = prefix_hash(arr, 3)[0], prefix_hash(arr, 4)[0]

        def digest(sums, s, e):
            return mix((sums[e] - sums[s]) * inverse[s])

        shape = ((place - first) * 256 + last - first).astype(np.uint64)
        context = mix(digest(one, first, end) + shape * np.uint64(0x9E3779B97F4A7C15))
        left, right = place - SIDE, place + K + SIDE
        sides = [np.where(fits, (digest(sums, s, e) >> np.uint64(48)) | np.uint64(1), np.uint64(0))
                 for fits, s, e in ((left >= first, np.maximum(left, first), place + K), (right <= end, place, np.minimum(right, end)))]
        more = (digest(two, first, end) >> np.uint64(32) << np.uint64(32)) | (sides[0] << np.uint64(16)) | sides[1]
        found.append((place + base, first + base, last + base, h[place], context, more))
    return tuple(np.concatenate(x) for x in zip(*found))


PLACES = "h long, part int, c1 long, c2 long, doc_id long, k1 long, packed long"


def _packed(place, first, last):
    """Place, bytes of the context before it and number of strings but one, in one integer."""
    return (place << 16) | ((place - first) << 8) | (last - first)


LATER = -1


def later_rows(h, c1, c2, doc, k1, packed) -> np.ndarray:
    """Rows whose context stands at an earlier place among these rows."""
    if len(c1) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(c1, kind="stable")
    same = c1[order[1:]] == c1[order[:-1]]
    some = order[np.r_[same, False] | np.r_[False, same]]
    some = some[np.lexsort([c[some] for c in (packed, k1, doc, c2, h, c1)])]
    a, b = some[1:], some[:-1]
    equal = (c1[a] == c1[b]) & (h[a] == h[b]) & (c2[a] == c2[b])
    other = (doc[a] != doc[b]) | (k1[a] != k1[b]) | (packed[a] != packed[b])
    # A repeated row is no earlier place; behind the first of its context it is covered with its twin.
    begin = np.flatnonzero(np.r_[True, ~equal]) if len(some) else np.zeros(0, np.int64)
    first = np.repeat(begin, np.diff(np.append(begin, len(some))))
    moved = np.maximum.accumulate(np.where(np.r_[False, equal & other], np.arange(len(some)), 0)) if len(some) else first
    return some[moved > first]


class _Places:
    """One short row per anchor of each text; frequent hashes are dealt by context.

    A context that stands earlier among the rows of the same batch is known to be
    covered: its row goes to any task, so copies do not crowd at their hash.
    """

    def __init__(self, frequent):
        self.frequent = np.array(sorted(frequent), dtype=np.int64)

    def __call__(self, batches):
        names = [x.split()[0] for x in PLACES.split(", ")]
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (text or "").encode()
                place, first, last, h, c1, c2 = anchors(data)
                if len(place):
                    out.append((h.view(np.int64), c1.view(np.int64), c2.view(np.int64), np.full(len(h), doc_id, np.int64), np.full(len(h), _key(data)[0], np.int64), _packed(place, first, last)))
            if not out:
                continue
            h, c1, c2, doc, k1, packed = map(np.concatenate, zip(*out))
            part = np.where(np.isin(h, self.frequent), c1 & (PARTS - 1), 0).astype(np.int32)
            later = later_rows(h, c1, c2, doc, k1, packed)
            part[later] = LATER
            h[later] = mix((k1[later] + packed[later]).view(np.uint64)).view(np.int64)  # to any task
            for at in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (h, part, c1, c2, doc, k1, packed)], names=names)


def _hashes(batches):
    """h: the different anchor hashes of each text."""
    for b in batches:
        for text in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(anchors((text or "").encode())[3]).view(np.int64))], names=["h"])


def frequent_hashes(docs: DataFrame) -> list[int]:
    """Hashes that stand in a hundredth of the texts of a bounded sample: fewer than a hundred texts have anchors."""
    sample = pick(docs, "text").filter("text IS NOT NULL").limit(SAMPLE_TEXTS)
    counts = sample.mapInArrow(_hashes, "h long").groupBy("h").agg(F.count("*").alias("n"))
    return [r.h for r in counts.filter(F.col("n") >= max(20, int(FREQUENT * SAMPLE_TEXTS))).collect()]


SHARED = "kind int, h long, c2 long, doc_id long, k1 long, packed long"


class _Shared:
    """What rows sorted by hash, part, context and place say.

    kind 0: an equal context stands earlier, so this one is covered whole; 1, 2 or
    3: a different context of the hash agrees on the left, the right or both sides.
    """

    def __init__(self, frequent):
        self.frequent = np.array(sorted(frequent), dtype=np.int64)

    def __call__(self, batches):
        held, self.before, self.open = None, None, None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5, 6)]
            later = b.column(1).to_numpy(zero_copy_only=False) == LATER
            if later.any():
                yield self._rows(np.zeros(later.sum(), dtype=np.int32), [c[later] for c in cols])
                cols = [c[~later] for c in cols]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            end = change[-1] + 1 if len(change) else 0
            if not end and len(cols[0]) >= HELD:
                end = len(cols[0])  # one hash only: pass on what is there
                whole = False
            else:
                whole = True
            held = [c[end:] for c in cols]
            if end:
                yield self._out([c[:end] for c in cols], whole)
        if held is not None and len(held[0]):
            yield self._out(held, True)

    def _out(self, cols, whole):
        h, c1, c2, doc, k1, packed = cols
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        again = np.zeros(len(h), dtype=bool)  # a repeated row is no earlier place
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (k1[1:] == k1[:-1]) & (packed[1:] == packed[:-1])
        if self.before is not None and self.before[:3] == (h[0], c1[0], c2[0]):
            new[0] = False
            again[0] = self.before[3:] == (doc[0], k1[0], packed[0])
        kind = np.zeros(len(h), dtype=np.int32)
        at = np.flatnonzero(new)
        if len(at):
            run = np.cumsum(np.r_[True, h[at][1:] != h[at][:-1]]).astype(np.int64)
            all_on = np.isin(h[at], self.frequent) | (h[at] == self.open if self.open is not None else False)
            if not whole:
                all_on |= h[at] == h[-1]
            for bit, shift in ((1, 16), (2, 0)):
                side = (c2[at] >> shift) & 0xFFFF
                _, where, n = np.unique((run << 16) | side, return_inverse=True, return_counts=True)
                kind[at] |= np.where((side != 0) & ((n[where] > 1) | all_on), bit, 0).astype(np.int32)
        self.before = (h[-1], c1[-1], c2[-1], doc[-1], k1[-1], packed[-1])
        self.open = None if whole else h[-1]
        keep = np.flatnonzero(~again & (~new | (kind > 0)))
        return self._rows(kind[keep], [c[keep] for c in cols])

    @staticmethod
    def _rows(kind, cols):
        h, _, c2, doc, k1, packed = cols
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, h, c2, doc, k1, packed)], names=["kind", "h", "c2", "doc_id", "k1", "packed"])


class _Base:
    def __call__(self, rows):
        for doc_id, text in rows:
            data = (text or "").encode()
            yield doc_id, *_key(data), len(data), hashlib.sha256(data).hexdigest()


class _Compressed:
    def __call__(self, rows):
        press = zstandard.ZstdCompressor(level=6)
        for doc_id, text in rows:
            data = (text or "").encode()
            yield doc_id, _key(data)[0], press.compress(data)


CONTEXT = "meet long, doc_id long, k1 long, start long, before int, strings int, bytes binary"


class _Contexts:
    """The bytes of the contexts that agree with another on a side, once for each such side."""

    def __call__(self, rows):
        open_ = zstandard.ZstdDecompressor()
        for doc_id, k1, z, wanted in rows:
            data = open_.decompress(z)
            for x in wanted:
                place, before, strings = x["packed"] >> 16, (x["packed"] >> 8) & 255, (x["packed"] & 255) + 1
                start = place - before
                for bit, shift in ((1, 16), (2, 0)):
                    if x["kind"] & bit:
                        # the side's digest is mixed with the hash, the last bit names the side
                        side = (x["c2"] >> shift) & 0xFFFF
                        meet = ((x["h"] ^ (side * 0x9E3779B97F4A7C15)) & ((1 << 63) - 1)) >> 1 << 1 | (bit - 1)
                        yield meet, doc_id, k1, start, before, strings, data[start : start + strings - 1 + LENGTH]


def sort_strings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each ordered row) of rows of big-endian words; equal rows share a class.

    Multikey sort to ``SHALLOW`` words, then blind tries, level by level: each
    group looks at the first word in which its members differ.
    """
    order = np.lexsort([words[:, c] for c in range(min(SHALLOW, words.shape[1]) - 1, -1, -1)])
    w = words[order]
    new = np.r_[True, (w[1:, :SHALLOW] != w[:-1, :SHALLOW]).any(axis=1)]
    active = np.arange(len(order))
    while True:
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        active = active[size[group[active]] > 1]
        if not len(active):
            break
        g = group[active]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        which = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
        rows = words[order[active]]
        differ = np.logical_or.reduceat(rows != rows[starts][which], starts, axis=0)
        branching = differ.any(axis=1)[which]
        active, which, rows = active[branching], which[branching], rows[branching]
        if not len(active):
            break
        word = rows[np.arange(len(rows)), differ.argmax(axis=1)[which]]
        inner = np.lexsort((word, which))
        order[active] = order[active][inner]
        word, which = word[inner], which[inner]
        split = np.r_[False, (word[1:] != word[:-1]) & (which[1:] == which[:-1])]
        new = new.copy()
        new[active[split]] = True
    return order, np.cumsum(new) - 1


class _Repeats:
    """Covered spans (doc_id, k1, s, e) of different contexts sorted by where they meet."""

    def __call__(self, rows):
        held, strings, group, key = [], 0, [], None
        for row in rows:
            if row[0] != key:
                if len(group) > 1:
                    held += group
                    strings += sum(r[5] for r in group)
                if strings >= EXPAND:
                    yield from self._covered(held)
                    held, strings = [], 0
                group, key = [], row[0]
            group.append(row)
        yield from self._covered(held + group if len(group) > 1 else held)

    @staticmethod
    def _covered(rows):
        if not rows:
            return
        rows = sorted(rows, key=lambda r: r[1:4])
        counts, before = np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
        ends = np.cumsum([len(r[6]) for r in rows])
        base = ends - [len(r[6]) for r in rows]
        data = np.frombuffer(b"".join(r[6] for r in rows) + bytes(8), dtype=np.uint8)
        meets = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
        owner = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        eight = np.zeros(len(data) - 7, dtype=np.uint64)
        for k in range(8):
            eight = (eight << np.uint64(8)) | data[k : len(data) - 7 + k]
        hit = np.zeros(len(owner), dtype=bool)
        if len(owner) <= 2 * EXPAND:
            turns = [np.arange(len(owner))]
        else:  # equal strings have the anchor at the same place
            offset = before[owner] - inside
            by_offset = np.argsort(offset, kind="stable")
            turns = np.split(by_offset, np.flatnonzero(np.diff(offset[by_offset])) + 1)
        for at in turns:
            own, start = owner[at], base[owner[at]] + inside[at]
            words = np.empty((len(at), WORDS + 1), dtype=np.uint64)
            for c in range(WORDS - 1):
                words[:, c] = eight[start + 8 * c]
            words[:, WORDS - 1] = eight[start + LENGTH - 8]
            words[:, WORDS] = meets[own]  # one meeting at a time
            order, cls = sort_strings(words)
            # Rows stand in order of document and place, so the smallest owner of a class is its earliest.
            earliest = np.full(cls[-1] + 1, len(rows), dtype=np.int64)
            np.minimum.at(earliest, cls, own[order])
            hit[at[order]] = own[order] > earliest[cls]
        at = np.flatnonzero(hit)
        if not len(at):
            return
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
        for run in np.split(at, cuts):
            row = rows[owner[run[0]]]
            yield row[1], row[2], row[3] + int(inside[run[0]]), row[3] + int(inside[run[-1]]) + LENGTH


class _Rest:
    """What is left of each document."""

    def __init__(self, texts):
        self.texts = texts

    def __call__(self, rows):
        open_ = zstandard.ZstdDecompressor()
        for doc_id, k1, z, spans in rows:
            data = open_.decompress(z)
            kept, at, removed, n = [], 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > at or not n:
                    kept.append(data[at:s])
                    n += 1
                if e > at:
                    removed += e - max(s, at)
                    at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            yield (doc_id, k1, len(data), removed, n, rest.decode("utf-8", "ignore") if self.texts else hashlib.sha256(rest).hexdigest())


def covered_spans(docs: DataFrame) -> DataFrame:
    """doc_id, k1, s, e: covered byte spans, which may overlap, of every document with an id."""
    known = docs.filter("doc_id IS NOT NULL")
    frequent = frequent_hashes(known)
    places = pick(known, "doc_id", "text").mapInArrow(_Places(frequent), PLACES)
    dealt = places.repartition("h", "part").sortWithinPartitions("h", "part", "c1", "c2", "doc_id", "k1", "packed")
    shared = cut(dealt.mapInArrow(_Shared(frequent), SHARED))
    start = F.shiftright("packed", 16) - F.shiftright("packed", 8).bitwiseAND(F.lit(255))
    whole = shared.filter("kind = 0").select("doc_id", "k1", start.alias("s"), (start + F.col("packed").bitwiseAND(F.lit(255)) + LENGTH).alias("e"))
    lists = shared.filter("kind > 0").groupBy("doc_id", "k1").agg(F.collect_set(F.struct("kind", "h", "c2", "packed")).alias("wanted"))
    packed = map_rows(pick(known, "doc_id", "text"), "doc_id long, k1 long, z binary", _Compressed())
    texts = packed.join(lists, ["doc_id", "k1"]).dropDuplicates(["doc_id", "k1"]).select("doc_id", "k1", "z", "wanted")
    contexts = map_rows(texts, CONTEXT, _Contexts())
    near = map_rows(contexts.repartition("meet").sortWithinPartitions("meet"), "doc_id long, k1 long, s long, e long", _Repeats())
    return whole.unionByName(near)


def deduplicate(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; with ``texts`` the rest as text instead of its digest.

    Bytes of a character of which a part is removed do not appear in the text.
    """
    base = cut(map_rows(pick(docs, "doc_id", "text"), "doc_id long, k1 long, k2 long, n_bytes long, sha string", _Base()))
    spans = cut(covered_spans(docs).groupBy("doc_id", "k1").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    packed = map_rows(pick(docs, "doc_id", "text").filter("doc_id IS NOT NULL"), "doc_id long, k1 long, z binary", _Compressed())
    changed = packed.join(spans, ["doc_id", "k1"]).dropDuplicates(["doc_id", "k1"]).select("doc_id", "k1", "z", "spans")
    rest = map_rows(changed, "r_id long, r_k1 long, r_bytes long, n_removed long, n_spans long, rest string", _Rest(texts))
    owners = base.filter("doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"))
    known = base.join(owners, ["k1", "k2"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    own = known.withColumn("copy", copy).join(rest, (F.col("doc_id") == F.col("r_id")) & (F.col("k1") == F.col("r_k1")), "left")
    none = F.lit("" if texts else hashlib.sha256(b"").hexdigest())
    untouched = F.lit(None).cast("string") if texts else F.col("sha")
    return own.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("rest", untouched)).alias("rest" if texts else "kept_sha256"),
        *(["k1"] if texts else []),
    )


class _TextKey:
    def __init__(self, at):
        self.at = at

    def __call__(self, rows):
        for row in rows:
            yield *row, _key((row[self.at] or "").encode())[0]


def rewritten(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated strings cut out of their text.

    A document whose text is covered whole goes; an empty text, and a null one,
    stay as they are.
    """
    result = deduplicate(docs, texts=True).select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k"), F.col("rest").alias("_rest"), F.col("n_removed").alias("_removed")).dropDuplicates(["_id", "_k"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = map_rows(docs, f"{schema}, _key long", _TextKey(docs.columns.index("text")))
    changed = result.filter("_removed > 0 AND _id IS NOT NULL")
    joined = keyed.join(changed, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    text = F.when(F.col("_removed") > 0, F.col("_rest")).otherwise(F.col("text"))
    return joined.filter(~F.coalesce((F.col("_removed") > 0) & (F.col("_rest") == ""), F.lit(False))).withColumn("text", text).select(*docs.columns)
