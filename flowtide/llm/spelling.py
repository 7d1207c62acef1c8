"""Spelling variants by a dictionary of trie-node pairs.

The counted words are sorted and cut into range blocks; so are their reversals.
Walking a sorted block numbers the nodes of the forward trie (prefixes) and of
the reversed trie (suffixes); nodes shared by two blocks are numbered from the
common prefixes of neighbouring block ends, one per block.  A word of length L
then is 2L + 1 pairs of integers, however long it is: ``L`` pairs that skip one
position (node of what stands before, node of what stands after) and ``L + 1``
that skip none.  Two words that differ by one replacement meet in one pair of
the first kind; a word and the same word with one code point more meet where the
longer one skips it.  A run of equal code points is skipped at its first place
only, so every neighbour is counted once.  A pair is shared by no more words than
there are letters, so no group grows with the corpus and no two words are ever
compared.

Word numbers follow code-point order, so ties go to the smaller number.  A form
has at least ``ratio`` times the count of its word; a chain of forms is therefore
no longer than the logarithm of the largest count, and its end is found by
pointer doubling in a number of rounds known beforehand.

Defined results: null and empty texts have no words; a null id is written as the
empty string where letters are dropped; repeated rows count as often as they
stand; equal counts go to the word that comes first; an empty table gives no
rows; other columns stay out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import LOWER, map_rows, pick
from flowtide.operators.ordering import BLOCK, ordered_blocks
from flowtide.session import cut

RUN = re.compile("[a-zÀ-ÿ]+")
# Different words a task counts before it hands its sums on.
HELD_WORDS = 400_000
BLOCK_WORDS = 500_000
# Numbers are block * 2^40 + place; block 0 holds the nodes that blocks share.
BLOCK_BITS = 40


class _Count:
    """word, n: partial counts of the words of a task's documents."""

    def __init__(self, min_length, drop_every):
        self.min_length, self.drop_every = min_length, drop_every

    def __call__(self, rows):
        held: dict[str, int] = {}
        for doc_id, text in rows:
            if not text:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
                if len(run) < self.min_length:
                    continue
                h = zlib.crc32(run.encode(), start)
                if h % self.drop_every == 0:
                    if len(run) == self.min_length:
                        continue
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                held[run] = held.get(run, 0) + n
            if len(held) >= self.HELD:
                yield from held.items()
                held = {}
        yield from held.items()

    HELD = HELD_WORDS


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words of at least ``min_length`` code points and ``min_count`` occurrences.

    One run in ``drop_every``, chosen by the crc32 of ``<id>:<run>``, loses a code point.
    """
    parts = map_rows(pick(docs, id_col, text_col), "word string, n long", _Count(min_length, drop_every))
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def shared_paths(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int]]]:
    """Per block: the prefix that its last word shares with the next block's first, and its node numbers.

    ``ends`` holds (block, first word, last word) in order.  Such a prefix stands in
    every block between any two blocks that share it, so comparing with the block
    before is enough.
    """
    out: dict[int, tuple[str, list[int]]] = {}
    before, path, made = "", [0], 0
    for (block, _, last), (_, first, _) in zip(ends, ends[1:]):
        prefix = last[: _common(last, first)]
        path = path[: _common(before, prefix) + 1]
        fresh = len(prefix) + 1 - len(path)
        path = path + list(range(made + 1, made + fresh + 1))
        made += fresh
        before = prefix
        out[block] = prefix, path
    return out


class _Walk:
    """Numbers the trie nodes along sorted (block, word, ...) rows and adds place and node path.

    The path has one number per prefix, the empty one (0) included.
    """

    def __init__(self, shared, order):
        self.shared = shared
        self.entering = {b: shared[a] for a, b in zip(order, order[1:]) if a in shared}

    def __call__(self, rows):
        block = None
        for b, word, *rest in rows:
            if b != block:
                block, last, path, made, place = b, "", [0], 0, -1
                base = (b + 1) << BLOCK_BITS
                (p_in, n_in), (p_out, n_out) = self.entering.get(b, ("", [0])), self.shared.get(b, ("", [0]))
            depth = _common(last, word)
            path = path[: depth + 1]
            for prefix, numbers in ((p_in, n_in), (p_out, n_out)):
                if len(path) <= len(prefix):
                    known = _common(prefix, word)
                    if known >= len(path):
                        path += numbers[len(path) : known + 1]
            fresh = len(word) + 1 - len(path)
            path += range(base + made, base + made + fresh)
            made += fresh
            place += 1
            last = word
            yield (base + place, word, *rest, path)


def trie_paths(words: DataFrame, rest: str) -> DataFrame:
    """place, word, the columns of ``rest`` (a DDL list, in the order of ``words``) and path: node numbers of all prefixes."""
    stored = cut(words)
    session = words.sparkSession
    blocks = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // BLOCK_WORDS))
    placed = ordered_blocks(stored, ["word"], blocks)
    # One row per block.
    ends = [tuple(r) for r in placed.groupBy(BLOCK).agg(F.min("word"), F.max("word")).orderBy(BLOCK).collect()]
    walked = placed.repartition(blocks, BLOCK).sortWithinPartitions(BLOCK, "word").select(BLOCK, *words.columns)
    return map_rows(walked, f"place long, word string, {rest}, path array<long>", _Walk(shared_paths(ends), [b for b, _, _ in ends]))


_PAIRS = "p long, s long, whole int, n long, id long, first int"


def _pairs(batches):
    """The pairs of every word; ``first`` marks the first place of a run of equal code points."""
    for t in batches:
        ids, n = (t.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        size = np.asarray(t.column(3).value_lengths(), dtype=np.int64)
        up, down = (t.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
        row = np.repeat(np.arange(len(size)), size)
        begin = (np.cumsum(size) - size)[row]
        i, length = np.arange(len(row)) - begin, size[row] - 1
        text = np.frombuffer("".join(t.column(2).to_pylist()).encode("utf-32-le"), dtype="<u4")
        skip = np.flatnonzero(i < length)
        at = skip - row[skip]  # one node more than code points in every word before
        first = np.ones(len(skip), dtype=bool)
        inner = i[skip] > 0
        first[inner] = text[at[inner]] != text[at[inner] - 1]
        cols = [
            np.concatenate([up, up[skip]]), np.concatenate([down[begin + length - i], down[(begin + length - i - 1)[skip]]]),
            np.concatenate([np.zeros(len(row), np.int32), np.ones(len(skip), np.int32)]),
            np.concatenate([n[row], n[row[skip]]]), np.concatenate([ids[row], ids[row[skip]]]),
            np.concatenate([np.zeros(len(row), np.int32), first.astype(np.int32)]),
        ]
        for a in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in cols], names=["p", "s", "whole", "n", "id", "first"])


def near_in_runs(p, s, skips, n, ids, first):
    """(id, near words, largest n, its id) for rows sorted by pair, whole before skips, n falling, id.

    ``skips`` is 0 for the one row of a pair that skips nothing.
    """
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
    run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(p))))
    where = np.arange(len(p))
    whole = skips[edge] == 0
    lead = edge + whole  # first skip of the run, if any
    k = np.diff(np.append(edge, len(p))) - whole
    big = len(p)
    # the whole word meets all skips that are the first of their run of letters
    firsts = np.add.reduceat(first, edge)
    best_first = np.minimum.reduceat(np.where(first == 1, where, big), edge)
    w = edge[whole & (firsts > 0)]
    out = [(ids[w], firsts[run[w]], n[best_first[run[w]]], ids[best_first[run[w]]])]
    # skips meet each other
    r = np.flatnonzero((skips == 1) & (k[run] > 1))
    other = lead[run[r]] + (r == lead[run[r]])
    out.append((ids[r], np.ones(len(r), np.int64) * (k[run[r]] - 1), n[other], ids[other]))
    # and those first in their run of letters the whole word
    r = np.flatnonzero((first == 1) & whole[run])
    own = edge[run[r]]
    out.append((ids[r], np.ones(len(r), np.int64), n[own], ids[own]))
    return [np.concatenate(c) for c in zip(*out)]


def _near(batches):
    """Near words per pair; a pair's rows may reach over the border of two batches."""
    held = None
    for t in batches:
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        p, s = cols[:2]
        change = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1]))
        if not len(change):
            held = cols
            continue
        end = change[-1] + 1
        held = [c[end:] for c in cols]
        yield _batch(near_in_runs(*[c[:end] for c in cols]))
    if held is not None and len(held[0]):
        yield _batch(near_in_runs(*held))


def _batch(cols):
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["id", "near", "best_n", "best_id"])


def near_words(paths: DataFrame, reverse_paths: DataFrame) -> DataFrame:
    """id, n_near, best (n and id of the near word of largest count) for words that have near words."""
    pairs = paths.join(reverse_paths, "id").select("id", "n", "word", "path", "down").mapInArrow(_pairs, _PAIRS)
    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s", "whole", F.col("n").desc(), "id")
    found = dealt.mapInArrow(_near, "id long, near long, best_n long, best_id long")
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("back")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame, largest: int, ratio: int) -> DataFrame:
    """id, root_id: the last of each chain of (id, form_id).

    A form counts at least ``ratio`` times as often as its word, which bounds the chains.
    """
    edges = int(math.log(max(largest, ratio), ratio)) + 1
    ends = forms.select("id", F.col("form_id").alias("root_id"))
    for _ in range(math.ceil(math.log2(edges))):
        step = ends.select(F.col("id").alias("at"), F.col("root_id").alias("next"))
        ends = cut(ends.join(step, ends["root_id"] == step["at"], "left").select("id", F.coalesce("next", "root_id").alias("root_id")))
    return ends


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of different words and counts (word, n)."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, else chains may be endless")
    paths = cut(trie_paths(words.select("word", "n"), "n long").withColumnRenamed("place", "id"))
    turned = paths.select(F.reverse("word").alias("word"), "id")
    down = trie_paths(turned, "id long").select("id", F.col("path").alias("down"))
    near = cut(near_words(paths, down))
    table = paths.select("id", "word", "n")
    judged = table.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.best_n") >= ratio * F.col("n"), -F.col("best.back")).alias("form_id"),
        F.when(F.col("best.best_n") >= ratio * F.col("n"), F.col("best.best_n")).alias("form_n"))
    judged = cut(judged)
    forms = judged.filter("form_id IS NOT NULL").select("id", "form_id")
    largest = judged.agg(F.max("form_n")).first()[0] or 0
    ends = roots(forms, largest, ratio)
    names = table.select(F.col("id").alias("f"), F.col("word").alias("form"))
    tops = table.select(F.col("id").alias("r"), F.col("word").alias("root"))
    named = forms.join(ends, "id").join(names, F.col("form_id") == F.col("f")).join(tops, F.col("root_id") == F.col("r")).select("id", "form", "root")
    return judged.drop("form_id").join(named, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, drop_every: int = 31) -> DataFrame:
    """The words of the documents with their near words, form and root."""
    return variants(word_counts(docs, min_length, min_count, drop_every), ratio)
