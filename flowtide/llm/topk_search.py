"""Exact top-k inner products by block-at-a-time pruning.

Rows are range-partitioned by id into blocks of at most ``BLOCK`` rows.  A block
keeps a forward index (its integer vectors) and the largest and smallest value
of each component.  For a query, a block cannot score above the sum over the
components of the larger of query x maximum and query x minimum.  Each query
visits blocks by falling bound and stops when the bound is below its k-th score;
equal bounds are visited, so ties go to the smaller id.

Queries are packed like blocks.  A task holds one range of blocks and a fixed
number of query packs; the results of all ranges meet in a ranked window with
partial limits.

Defined results: a vector that is null, or holds a null or non-finite
component, takes no part, nor does a null id; a query meets only vectors of its
own length; rows equal in id and vector count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import pick
from flowtide.session import cut

BLOCK = 1024
RANGE_ROWS = 16 * BLOCK
PACKED = "dim int, n int, ids binary, marks binary, vectors binary"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, vec (floor of scale * component), mark (distinguishes rows of equal id)."""
    v = pick(vectors, id_col, vector_col).toDF("vec_id", "raw")
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return (
        v.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).filter(sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("vec"))
        .withColumn("mark", F.xxhash64("vec")).dropDuplicates(["vec_id", "vec"])
    )


def _pack(batches):
    """Sorted rows of one partition into packs of at most BLOCK rows of equal length."""
    rows: list = []

    def flush():
        ids, marks, vecs = zip(*rows)
        return [len(vecs[0]), len(rows), np.array(ids, dtype="<i8").tobytes(), np.array(marks, dtype="<i8").tobytes(), np.array(vecs, dtype="<i8").tobytes()]

    def batch(held):
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=["dim", "n", "ids", "marks", "vectors"])

    for b in batches:
        ids, marks = b.column(0).to_pylist(), b.column(2).to_pylist()
        lists = b.column(1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(lists.value_lengths()))
        for i, e in enumerate(ends):
            vec = flat[(ends[i - 1] if i else 0) : e]
            if rows and (len(rows) == BLOCK or len(rows[0][2]) != len(vec)):
                yield batch([flush()])
                rows.clear()
            rows.append((ids[i], marks[i], vec))
    if rows:
        yield batch([flush()])


def _packs(vectors: DataFrame, parts: int) -> DataFrame:
    ordered = vectors.select("vec_id", "vec", "mark", F.size("vec").alias("dim")).repartitionByRange(parts, "dim", "vec_id").sortWithinPartitions("dim", "vec_id")
    return ordered.select("vec_id", "vec", "mark").mapInArrow(_pack, PACKED)


class _Unpacked:
    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, dtype="<i8")
        self.marks = np.frombuffer(row.marks, dtype="<i8")
        self.vectors = np.frombuffer(row.vectors, dtype="<i8").reshape(row.n, row.dim)
        self.high = self.vectors.max(axis=0, initial=np.iinfo(np.int64).min) if row.dim else np.zeros(0, np.int64)
        self.low = self.vectors.min(axis=0, initial=np.iinfo(np.int64).max) if row.dim else np.zeros(0, np.int64)
        self.size = float(max(np.abs(self.vectors.astype(float)).max(initial=0.0), 1.0))


def _exact(a, b, size):
    """Integer matrix product: in doubles where every partial sum stays below 2^53, else in Python integers."""
    if size * max(a.shape[-1], 1) < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def search_blocks(queries: _Unpacked, blocks: list[_Unpacked], k: int):
    """(query index, id, score) of the k best rows of these blocks for every query."""
    q = queries.vectors
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    high, low = np.stack([b.high for b in blocks], axis=1), np.stack([b.low for b in blocks], axis=1)
    size = queries.size * max(b.size for b in blocks)
    bounds = _exact(up, high, size) + _exact(down, low, size)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in q]  # (-score, id), sorted
    active = np.arange(len(q))
    for r in range(len(blocks)):
        still = [i for i in active if len(best[i]) < k or bounds[i, order[i, r]] >= -best[i][-1][0]]
        if not still:
            break
        active = np.array(still)
        for b in np.unique(order[active, r]):
            mine, block = active[order[active, r] == b], blocks[b]
            scores = _exact(q[mine], block.vectors.T, size)
            for i, s in zip(mine, scores):
                ok = block.ids != queries.ids[i]
                s, ids = s[ok], block.ids[ok]
                if len(s) > k:
                    floor = np.partition(s, len(s) - k)[len(s) - k]
                    if len(best[i]) == k:
                        floor = max(floor, -best[i][-1][0])
                    s, ids = s[s >= floor], ids[s >= floor]
                best[i] = sorted([*best[i], *((-int(x), int(d)) for x, d in zip(s, ids))])[:k]
    for i, rows in enumerate(best):
        for score, d in rows:
            yield i, d, -score


class _Search:
    def __init__(self, k):
        self.k = k

    def __call__(self, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = [_Unpacked(b) for b in blocks.itertuples()]
        for row in queries.itertuples():
            q = _Unpacked(row)
            same = [b for b in held if b.vectors.shape[1] == q.vectors.shape[1]]
            if same:
                out += [(int(q.ids[i]), int(q.marks[i]), d, s) for i, d, s in search_blocks(q, same, self.k)]
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as given by ``integer_vectors``."""
    vectors, queries = cut(vectors), cut(queries)
    parts = max(1, -(-vectors.count() // RANGE_ROWS))
    chunks = max(1, -(-queries.count() // RANGE_ROWS))
    # Each task key is one range of blocks and one chunk of query packs.
    keyed_blocks = _packs(vectors, parts).withColumn("part", F.spark_partition_id()).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keyed_packs = _packs(queries, chunks).withColumn("chunk", F.spark_partition_id()).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    search = _Search(k)

    def one(packs, blocks):
        return search(packs, blocks)

    found = (
        keyed_packs.groupBy("part", "chunk").cogroup(keyed_blocks.groupBy("part", "chunk"))
        .applyInPandas(one, "query_id long, mark long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
