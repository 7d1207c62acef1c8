"""Best-fit packing by linear grouping.

The driver plans on the histogram of piece lengths, which has at most
``capacity`` rows whatever the corpus size:

1. lengths above ``capacity / 3`` form groups of equal cardinality and are
   rounded up to the largest of their group;
2. configurations of the few rounded sizes are optimised by column generation
   (simplex over the demands, knapsack pricing) and used a whole number of times;
3. actual lengths take the slots of their group;
4. what is left, small pieces above all, goes best-fit into the rests, longest first;
5. sequences that keep a rest are opened once more for the best fit, if that needs fewer.

The plan is a table of (length, rank interval, first sequence, offset) whose
size does not grow with the corpus.  Spark ranks the pieces of each length in
salted groups and joins them to the plan.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm import tokens
from flowtide.llm.common import map_rows, pick
from flowtide.session import cut

CAPACITY = 2048
GROUPS = 64
LARGE = 3          # a length above capacity / LARGE is large
PIVOTS = 4000      # simplex steps at most; every step's basis is a valid plan
SALT_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Pieces:
    def __init__(self, paths, capacity, end_id):
        self.paths, self.capacity, self.end = paths, capacity, np.array([end_id], dtype=np.uint32)

    def __call__(self, rows):
        encode, cap = tokens.encoder(*self.paths), self.capacity
        for doc_id, text in rows:
            ids = np.concatenate([encode(text), self.end]).astype("<u4", copy=False)
            first = len(ids) % cap or cap
            start = 0
            for piece, end in enumerate(range(first, len(ids) + 1, cap)):
                yield doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())
                start = end


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; only the first of a document may be shorter.

    A null or empty text is one piece that holds the end id.  Repeated rows and
    null ids each give their own pieces.
    """
    return map_rows(pick(docs, "doc_id", "text"), PIECES, _Pieces(paths or tokens.default_paths(), capacity, end_id))


def _knapsack(sizes, values, capacity):
    """Counts per size of the most valuable filling of one sequence."""
    best = np.zeros(capacity + 1)
    steps = []
    for g, (s, v) in enumerate(zip(sizes, values)):
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):
            with_it = np.zeros(capacity + 1)
            with_it[s:] = best[:-s] + v
            better = with_it > best + 1e-12
            if not better.any():
                break
            steps.append((g, s, better))
            best = np.where(better, with_it, best)
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for g, s, better in reversed(steps):
        if better[room]:
            counts[g] += 1
            room -= s
    return counts, best[capacity]


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, counts per size) of a linear-programming optimum, rounded down."""
    k = len(sizes)
    basis = [np.eye(k, dtype=np.int64)[g] * (capacity // sizes[g]) for g in range(k)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, dtype=float)
    for _ in range(PIVOTS):
        duals = inverse.sum(axis=0)
        column, value = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.full(k, np.inf)
        ratio[usable] = x[usable] / direction[usable]
        out = int(np.argmin(ratio))
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        basis[out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        x = np.maximum(x, 0)
    return [(int(np.floor(t + 1e-7)), c) for t, c in zip(x, basis) if t >= 1 - 1e-7]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Classes (number of sequences, lengths in them) that hold every counted piece."""
    classes: list[tuple[int, list[int]]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    if capacity in left:
        classes.append((left.pop(capacity), [capacity]))
    large = sorted((n for n in left if n > capacity // LARGE), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        k = min(groups, len(large))
        bounds = [total * (g + 1) // k for g in range(k)]
        queues: list[list[list[int]]] = [[] for _ in range(k)]
        g = seen = 0
        for n in large:
            todo = left[n]
            while todo:
                while bounds[g] <= seen:
                    g += 1
                take = min(todo, bounds[g] - seen)
                queues[g].append([n, take])
                seen, todo = seen + take, todo - take
        queues = [q for q in queues if q]
        chosen = configurations([q[0][0] for q in queues], [sum(c for _, c in q) for q in queues], capacity)
        for times, config in chosen:
            parts = [(times, [])]
            for g in np.flatnonzero(config):
                for _ in range(config[g]):
                    parts = _fill(parts, queues[g], left)
            classes += parts
    packed = _best_fit(classes, left, capacity)
    full = [(times, lengths) for times, lengths in packed if sum(lengths) == capacity]
    opened = {n: c for n, c in counts.items() if c > 0}
    for times, lengths in full:
        for n in lengths:
            opened[n] -= times
    again = _best_fit(full, opened, capacity)
    return min(packed, again, key=lambda p: sum(times for times, _ in p))


def _fill(parts, queue, left):
    """One slot of every sequence in ``parts`` takes the next piece of ``queue``."""
    out = []
    for times, lengths in parts:
        while times and queue:
            n, have = queue[0]
            take = min(times, have)
            out.append((take, [*lengths, n]))
            left[n] -= take
            times -= take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        if times:
            out.append((times, lengths))
    return out


def _best_fit(classes, left, capacity):
    """Longest first, each into the sequence with the least room that takes it."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for times, lengths in classes:
        if times:
            room.setdefault(capacity - sum(lengths), []).append((times, lengths))
    rests = sorted(room)
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(rests, n)
            if at == len(rests):
                per = capacity // n
                whole, tail = divmod(todo, per)
                for times, lengths in ((whole, [n] * per), (1 if tail else 0, [n] * tail)):
                    if times:
                        _put(room, rests, capacity - sum(lengths), times, lengths)
                break
            r = rests[at]
            times, lengths = room[r].pop()
            if not room[r]:
                del room[r]
                rests.pop(at)
            take = min(times, todo)
            if times > take:
                _put(room, rests, r, times - take, lengths)
            _put(room, rests, r - n, take, [*lengths, n])
            todo -= take
    return [c for held in room.values() for c in held]


def _put(room, rests, rest, times, lengths):
    if rest not in room:
        room[rest] = []
        bisect.insort(rests, rest)
    room[rest].append((times, lengths))


def places(classes: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) rows of a plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in classes:
        offset = 0
        for n in lengths:
            at = used.get(n, 0)
            rows.append((n, at, at + times, sequence, offset))
            used[n] = at + times
            offset += n
        sequence += times
    return rows


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    An empty table gives no rows.  Pieces of equal length are interchangeable;
    which of them takes which place is decided by doc_id, piece and start.
    """
    spark = docs.sparkSession
    stored = cut(pieces(docs, paths, capacity))
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = places(plan(counts, capacity))
    table = spark.createDataFrame(rows, "p_length long, rank_from long, rank_to long, seq_from long, offset long")
    salts = max(64, -(-max(counts.values(), default=1) // SALT_ROWS))
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select(
        F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = (
        salted.withColumn("rn", F.row_number().over(own) - 1)
        .join(bases, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
        .withColumn("rank", F.col("base") + F.col("rn"))
    )
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(table), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
