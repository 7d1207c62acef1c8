"""Exact k nearest neighbours as a block join.

1. Equal vectors collapse to one point that remembers its k lowest ids, so a
   vector repeated by a third of all rows is one point.
2. A k-d partition learnt from a sample cuts the points into blocks of a few
   thousand; every block gets its exact bounding box.
3. Each point searches its own block, which bounds its k-th distance, and then
   only those other blocks whose box is no farther than that bound, found by
   descending a tree of boxes.  The answer is exact whatever the sample looked
   like; the sample only decides how many blocks are skipped.
4. Neighbouring blocks form a region.  A point goes to a region once, with the
   blocks it asks for there, and leaves it with one list; a region that many
   points ask for is split over several tasks by salt.
5. Inside a task a matrix product with an error bound names the candidates;
   their distances are then computed term by term.

``method="lsh"`` answers approximately with bounded work per point.  Each of
several tables projects the vectors on its own random directions and parts them
at medians of a sample, so bucket lengths follow the data and a bucket holds a
fixed number of points however many there are; a point is compared with its
bucket mates of every table only.  A point that finds too few mates (a rare
group, say) falls back to the exact search.

Order of neighbours: squared Euclidean distance, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide.functions import hash_unit
from flowtide.session import cut

BLOCK_POINTS = 1_000        # aimed-at points per block
MAX_BLOCKS = 65_536         # bounds the box table (and the sample) that tasks receive
MAX_BOXES = 4 * MAX_BLOCKS  # blocks of all groups together
SAMPLE_PER_BLOCK = 16
REGION_BLOCKS = 32          # neighbouring blocks that one task searches
PROBES_PER_TASK = 20_000    # points that search one region in one task
MAX_TASKS = 4_096           # partitions of a search at most
BOX_FAN = 8                 # children of a node in the tree of boxes
BOX_PROBES = 2_000          # points that descend the tree of boxes at a time
CELLS = 200_000             # distances computed at a time: stays in cache
LSH_TABLES = 8              # independent sets of random directions
LSH_BUCKET = 512            # aimed-at points per bucket; none holds more than twice as many
LSH_DIRECTIONS = 16         # random directions per table
HOT_SHARE = 1_000           # a vector with more than 1/1000 of the rows is hot: fewer than 1,000 such
HOT_ROWS = 100_000          # and below this many rows none is


# --- small numpy helpers that run inside tasks ------------------------------

def _grow_partition(points: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Median splits along the dimension of largest variance.

    Returns arrays (dim, threshold, left, right); dim -1 marks a leaf and
    ``left`` then holds its number.
    """
    dim, thr, left, right = [], [], [], []
    n_leaf = 0
    todo = [(points, leaves, -1, False)]
    while todo:
        pts, want, parent, is_right = todo.pop()
        me = len(dim)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        d, t = -1, 0.0
        if want > 1 and len(pts) > 1:
            d = int(np.argmax(pts.var(axis=0)))
            t = float(np.median(pts[:, d]))
            below = pts[:, d] <= t
            if below.all():                       # the median is the maximum
                below = pts[:, d] < t
                t = float(pts[below, d].max()) if below.any() else t
            if not below.any() or below.all():
                d = -1
        dim.append(d)
        thr.append(t)
        left.append(-1)
        right.append(-1)
        if d < 0:
            left[me] = n_leaf
            n_leaf += 1
        else:
            todo.append((pts[below], want // 2, me, False))
            todo.append((pts[~below], want - want // 2, me, True))
    return [np.array(dim), np.array(thr), np.array(left), np.array(right)]


def _find_leaf(tree: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    dim, thr, left, right = tree
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        live = np.flatnonzero(dim[at] >= 0)
        if not len(live):
            return left[at]
        node = at[live]
        go_left = x[live, dim[node]] <= thr[node]
        at[live] = np.where(go_left, left[node], right[node])


class _Boxes:
    """Boxes in block order under a tree whose nodes hold the union of ``BOX_FAN`` neighbours below them."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, groups: np.ndarray):
        self.names, code = np.unique(groups, return_inverse=True)
        self.levels = [(lo, hi, code, code)]
        while len(self.levels[-1][0]) > BOX_FAN:
            lo, hi, first, last = self.levels[-1]
            at = np.arange(0, len(lo), BOX_FAN)
            self.levels.append((np.fmin.reduceat(lo, at), np.fmax.reduceat(hi, at),
                                np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def near(self, x: np.ndarray, bound: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of every box of a row's group no farther than its bound, in row order."""
        code = np.searchsorted(self.names, groups)
        code = np.where(self.names[np.minimum(code, len(self.names) - 1)] == groups, code, -1)
        top = len(self.levels[-1][0])
        row, node = np.repeat(np.arange(len(x)), top), np.tile(np.arange(top), len(x))
        for level in range(len(self.levels) - 1, -1, -1):
            lo, hi, first, last = self.levels[level]
            own = code[row]
            same = (first[node] <= own) & (own <= last[node])
            row, node = row[same], node[same]
            d = np.zeros(len(row))
            with np.errstate(invalid="ignore"):
                for j in range(x.shape[1]):
                    v = x[row, j]
                    gap = np.maximum(np.maximum(lo[node, j] - v, v - hi[node, j]), 0.0)
                    d += gap * gap
                # a node without a distance decides nothing; a box without one is not near
                keep = d <= bound[row] if level == 0 else ~(d > bound[row])
            row, node = row[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][0])
                row, node = np.repeat(row, BOX_FAN), (node[:, None] * BOX_FAN + np.arange(BOX_FAN)).ravel()
                row, node = row[node < below], node[node < below]
        return row, node


def _candidates(x, s, bound, k):
    """(row, column) pairs of one chunk that hold every pair of the answer, from full distances."""
    d = np.zeros((len(x), len(s)))
    diff = np.empty_like(d)
    columns = np.ascontiguousarray(s.T)
    for j in range(x.shape[1]):
        np.subtract(x[:, j, None], columns[j], out=diff)
        np.multiply(diff, diff, out=diff)
        d += diff
    top = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1]) if len(s) > k else bound
    return np.nonzero(d <= top[:, None])


def _closest(x, s, bound, k):
    """(row, column, d2): the k columns of ``s`` nearest to each row no farther than ``bound``, by distance and column."""
    out_r, out_c, out_d = [], [], []
    step = max(1, CELLS // max(len(s), 1))
    slack = 8.0 * (x.shape[1] + 8) * np.finfo(float).eps  # bounds the rounding of all forms of a distance, as a share of the norms
    with np.errstate(all="ignore"):
        mid = np.median(s, axis=0) if len(s) else np.zeros(x.shape[1])
        xc, sc = x - mid, s - mid
        xn, sn = np.einsum("ij,ij->i", xc, xc), np.einsum("ij,ij->i", sc, sc)
    safe = max(xn.max(initial=0.0), sn.max(initial=0.0)) < 1e300  # False for NaN as well
    turned, low_s = np.ascontiguousarray(-2.0 * sc.T) if safe else None, (1.0 - 2.0 * slack) * sn
    for a in range(0, len(x), step):
        part = slice(a, a + step)
        if not safe:
            with np.errstate(all="ignore"):
                r, c = _candidates(x[part], s, bound[part], k)
        else:
            low = xc[part] @ turned  # becomes a lower bound of the distance, less the row's own norm
            low += low_s
            top, norm = bound[part].copy(), xn[part]
            loose = np.flatnonzero(np.isinf(top)) if len(s) > k else []
            if len(loose):
                some = low if len(loose) == len(low) else low[loose]
                at = np.argpartition(some, k - 1, axis=1)[:, :k]
                up = np.take_along_axis(some, at, axis=1) + 4.0 * slack * sn[at]
                top[loose] = up.max(axis=1) + (1.0 + 2.0 * slack) * norm[loose]
            r, c = np.nonzero(low <= (top - (1.0 - 2.0 * slack) * norm + 1e-300)[:, None])
        d = np.zeros(len(r))
        with np.errstate(all="ignore"):
            for j in range(x.shape[1]):
                diff = x[part][r, j] - s[c, j]
                diff *= diff
                d += diff
        inside = d <= bound[part][r]
        r, c, d = r[inside], c[inside], d[inside]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        out_r.append(r[keep] + a)
        out_c.append(c[keep])
        out_d.append(d[keep])
    if not out_r:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(out_r), np.concatenate(out_c), np.concatenate(out_d)


def _nearest(q_id, q, bound, s_id, s, k):
    """k nearest of ``s`` for each of ``q`` no farther than ``bound``; ``s`` sorted by id."""
    r, c, d = _closest(q, s, bound, k)
    return pd.DataFrame({"q": q_id[r], "s": s_id[c], "d2": d})


def _search_region(q, bound, asked, blocks, s_id, s, s_block, k):
    """(count, ids, distances) per row of ``q``: its k nearest among the blocks (``asked`` row, ``blocks``) it asks for.

    The bound of a row falls from block to block.
    """
    order = np.lexsort((s_id, s_block))
    s_id, s, s_block = s_id[order], s[order], s_block[order]
    order = np.argsort(blocks, kind="stable")
    asked, blocks = asked[order], blocks[order]
    count = np.zeros(len(q), dtype=np.int64)
    ids, dist = np.zeros((len(q), k), dtype=np.int64), np.full((len(q), k), np.inf)
    for b in np.unique(blocks):
        rows = asked[np.searchsorted(blocks, b):np.searchsorted(blocks, b, side="right")]
        held = slice(np.searchsorted(s_block, b), np.searchsorted(s_block, b, side="right"))
        limit = np.where(count[rows] == k, np.minimum(bound[rows], dist[rows, k - 1]), bound[rows])
        r, c, d = _closest(q[rows], s[held], limit, k)
        if not len(r):
            continue
        # what the rows hold already, and what is new, by distance and id
        old = np.unique(r)
        seat = np.arange(k) < count[rows[old], None]
        at = np.concatenate([np.repeat(old, count[rows[old]]), r])
        all_d = np.concatenate([dist[rows[old]][seat], d])
        all_s = np.concatenate([ids[rows[old]][seat], s_id[held][c]])
        order = np.lexsort((all_s, all_d, at))
        at, all_d, all_s = at[order], all_d[order], all_s[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        first = place < k
        at, place = rows[at[first]], place[first]
        dist[at, place], ids[at, place] = all_d[first], all_s[first]
        np.maximum.at(count, at, place + 1)
    return count, ids, dist


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    if len(flat) != len(column) * dims:
        raise ValueError("vectors must not be null and must all have the same length")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)


def _numbers(column, kind=np.int64) -> np.ndarray:
    return np.asarray(column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False), dtype=kind)


# --- the Spark job ----------------------------------------------------------

def _vector(features: list[str] | str) -> Column:
    # adding 0.0 turns -0.0 into 0.0, so equal numbers hash alike
    if isinstance(features, str):
        return F.transform(F.col(features), lambda x: x.cast("double") + 0.0)
    return F.array(*[F.col(c).cast("double") + 0.0 for c in features])


def _points(rows: DataFrame, k: int) -> DataFrame:
    """(point, v, members): one row per distinct (group, vector), with the k lowest ids of its rows.

    The rank filter runs before the shuffle as well, so each task sends at
    most k rows per vector.
    """
    # the hash leads the key: sorts then compare numbers, and vectors only where hashes agree
    rank = F.row_number().over(Window.partitionBy("h", "g", "v").orderBy("id"))
    first = rows.withColumn("h", F.xxhash64("g", "v")).withColumn("_r", rank).where(F.col("_r") <= k)
    return first.groupBy("h", "g", "v").agg(
        F.min("id").alias("point"), F.sort_array(F.collect_list(F.struct("id", "tag"))).alias("members"))


FOUND = "nn array<struct<d2:double,s:bigint>>"


def _probe(probes: DataFrame, points: DataFrame, k: int, dims: int, carry: list[str]) -> DataFrame:
    """The probes (q, v, bound, region, blocks) with ``nn``: their k nearest points of the named blocks, nearest first."""
    crowd = probes.groupBy("region").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(PROBES_PER_TASK)).cast("int").alias("parts"))
    sizes = crowd.collect()  # at most MAX_BOXES / REGION_BLOCKS rows
    crowd = F.broadcast(probes.sparkSession.createDataFrame(sizes, crowd.schema))
    # a task's work does not show in its bytes: the number is set, so that small shuffles are not merged into few tasks
    tasks = max(1, min(2 * sum(r["parts"] for r in sizes), MAX_TASKS))
    asked = probes.join(crowd, "region").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
    held = points.select(_region("block").alias("region"), "block", F.col("point").alias("s"), F.col("v").alias("sv")).join(
        crowd, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(qs: pa.Table, ss: pa.Table) -> pa.Table:
        n = qs.num_rows
        count, ids, dist = np.zeros(n, dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        if n and ss.num_rows:
            blocks = qs["l_blocks"].combine_chunks()
            lengths = _numbers(pc.list_value_length(blocks))
            count, ids, dist = _search_region(
                _matrix(qs["l_v"], dims), _numbers(qs["l_bound"], float), np.repeat(np.arange(n), lengths), _numbers(blocks.flatten()),
                _numbers(ss["r_s"]), _matrix(ss["r_sv"], dims), _numbers(ss["r_block"]), k)
        seat = np.arange(k) < count[:, None]
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()),
            pa.StructArray.from_arrays([pa.array(dist[seat], pa.float64()), pa.array(ids[seat], pa.int64())], ["d2", "s"]))
        return pa.table([*[qs[f"l_{c}"] for c in carry], lists], names=[*carry, "nn"])

    # both sides come from the same stored points: rename so that their columns stay apart
    left = asked.toDF(*[f"l_{c}" for c in asked.columns]).repartition(tasks, "l_region", "l_part")
    right = held.toDF(*[f"r_{c}" for c in held.columns]).repartition(tasks, "r_region", "r_part")
    schema = ", ".join([*[f"{c} {t}" for c, t in probes.select(*carry).dtypes], FOUND])
    return left.groupBy("l_region", "l_part").cogroup(right.groupBy("r_region", "r_part")).applyInArrow(search, schema)


def _region(block: str) -> Column:
    return F.floor(F.col(block) / REGION_BLOCKS).cast("bigint")


def _point_neighbors(points: DataFrame, queries: DataFrame | None, dims: int, k: int) -> DataFrame:
    """(q, s, d2): the k nearest points of each query point, exact."""
    spark = points.sparkSession
    n = points.count()
    leaves = int(min(max(n // BLOCK_POINTS, 1), MAX_BLOCKS))
    share = min(1.0, leaves * SAMPLE_PER_BLOCK / max(n, 1))
    tree = None
    if leaves > 1:
        drawn = points.where(hash_unit("point", 17) < share).select("v").toPandas()
        if len(drawn):
            tree = spark.sparkContext.broadcast(_grow_partition(np.stack(drawn["v"]), leaves))

    def placed(df: DataFrame) -> DataFrame:
        if tree is None:
            return df.withColumn("leaf", F.lit(0).cast("bigint"))

        @F.pandas_udf("bigint")
        def leaf_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in it:
                yield pd.Series(_find_leaf(tree.value, np.stack(v)) if len(v) else [], dtype="int64")

        return df.withColumn("leaf", leaf_of("v"))

    pts = cut(placed(points).select("g", "point", "v", "leaf"))
    box = pts.groupBy("g", "leaf").agg(
        F.array(*[F.min(F.col("v")[j]) for j in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("v")[j]) for j in range(dims)]).alias("hi"))
    boxes = box.orderBy("g", "leaf").limit(MAX_BOXES + 1).toPandas()
    if len(boxes) > MAX_BOXES:
        raise ValueError("too many groups for one call: split the table by group ranges")
    if not len(boxes):
        return spark.createDataFrame([], "q bigint, s bigint, d2 double")
    boxes["block"] = np.arange(len(boxes))
    ids = spark.createDataFrame(boxes[["g", "leaf", "block"]], "g string, leaf bigint, block bigint")

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(ids), ["g", "leaf"], "left")

    held = numbered(pts)
    asked = pts if queries is None else cut(placed(queries).select("g", "point", "v", "leaf"))
    asked = numbered(asked).withColumnRenamed("point", "q").select("q", "v", "g", "block")
    inf = F.lit(float("inf"))
    inside = asked.where("block is not null").withColumns({"bound": inf, "region": _region("block"), "blocks": F.array("block")})
    carry = ["q", "v", "g", "block"]
    own = _probe(inside, held, k, dims, carry)
    if queries is not None:
        own = own.unionByName(asked.where("block is null").withColumn("nn", F.expr(f"from_json('[]', '{FOUND[3:]}')")))
    if len(boxes) == 1 and queries is None:
        return own.select("q", F.inline("nn")).select("q", "s", "d2")
    own = cut(own)
    bounded = own.select(*carry, F.when(F.size("nn") == k, F.element_at("nn", -1)["d2"]).otherwise(inf).alias("bound"))
    shared = spark.sparkContext.broadcast(_Boxes(np.stack(boxes["lo"]).astype(float), np.stack(boxes["hi"]).astype(float),
                                                 boxes["g"].to_numpy().astype(str)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BOX_PROBES):
                b = whole.slice(a, BOX_PROBES)
                row, block = shared.value.near(_matrix(b["v"], dims), _numbers(b["bound"], float), np.array(b["g"].to_pylist(), dtype=str))
                home = _numbers(b["block"].fill_null(-1))
                row, block = row[block != home[row]], block[block != home[row]]
                order = np.lexsort((block, row))
                row, block = row[order], block[order]
                region = block // REGION_BLOCKS
                start = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(region, prepend=-1).astype(bool))
                taken = b.select(["q", "v", "bound"]).take(pa.array(row[start]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(block, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(region[start], pa.int64()), lists],
                                                 names=["q", "v", "bound", "region", "blocks"])

    further = cut(bounded.mapInArrow(others, "q bigint, v array<double>, bound double, region bigint, blocks array<bigint>"))
    more = _probe(further, held, k, dims, ["q"]).where(F.size("nn") > 0)
    more = more.groupBy("q").agg(F.flatten(F.collect_list("nn")).alias("more"))
    both = own.select("q", "nn").join(more, "q", "left")
    best = F.when(F.col("more").isNull(), F.col("nn")).otherwise(F.slice(F.array_sort(F.concat("nn", "more")), 1, k))
    return both.select("q", F.inline(best)).select("q", "s", "d2")


def _directions(table: int, dims: int) -> np.ndarray:
    """Random orthonormal directions of one table, as columns."""
    q, _ = np.linalg.qr(np.random.default_rng([table, dims]).standard_normal((dims, dims)))
    return q[:, :LSH_DIRECTIONS]


def _bucket_pairs(q_id, q, s_id, s, k: int, most: int, table: int, depth: int = 0) -> list[pd.DataFrame]:
    """k nearest within one bucket; a bucket above ``most`` points is parted at the median of further directions."""
    if not len(q) or not len(s):
        return []
    if len(s) > most:
        for attempt in range(8):
            a = np.random.default_rng([table, depth, attempt, 7]).standard_normal(s.shape[1])
            at_s, at_q = s @ a, q @ a
            cut_at = np.median(at_s)
            low = at_s <= cut_at
            if 0 < low.sum() < len(s):
                below = at_q <= cut_at
                return (_bucket_pairs(q_id[below], q[below], s_id[low], s[low], k, most, table, depth + 1)
                        + _bucket_pairs(q_id[~below], q[~below], s_id[~low], s[~low], k, most, table, depth + 1))
    order = np.argsort(s_id)
    return [_nearest(q_id, q, np.full(len(q), np.inf), s_id[order], s[order], k)]


def _approximate_neighbors(points: DataFrame, queries: DataFrame | None, dims: int, k: int) -> DataFrame:
    """(q, s, d2): k near points of each query point among its bucket mates of all tables."""
    tables, bucket = LSH_TABLES, LSH_BUCKET
    spark = points.sparkSession
    n = points.count()
    leaves = int(min(max(n // bucket, 1), MAX_BLOCKS))  # beyond, buckets are parted further inside the tasks
    share = min(1.0, leaves * SAMPLE_PER_BLOCK / max(n, 1))
    drawn = points.where(hash_unit("point", 17) < share).select("v").toPandas() if leaves > 1 else []
    turns = [_directions(t, dims) for t in range(tables)]
    trees = [_grow_partition(np.stack(drawn["v"]) @ r, leaves) if len(drawn) else None for r in turns]
    known = spark.sparkContext.broadcast((turns, trees))

    @F.pandas_udf("array<bigint>")
    def buckets(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        turns, trees = known.value
        for v in it:
            x = np.stack(v) if len(v) else np.zeros((0, dims))
            at = [_find_leaf(t, x @ r) if t is not None else np.zeros(len(x), dtype=np.int64) for r, t in zip(turns, trees)]
            yield pd.Series(list(np.stack(at, axis=1)) if len(x) else [], dtype=object)

    def hashed(df: DataFrame) -> DataFrame:
        return df.select("g", "point", "v", F.posexplode(buckets("v")).alias("tab", "leaf"))

    keys, pairs = ["tab", "g", "leaf"], "q bigint, s bigint, d2 double"
    nothing = {"q": "int64", "s": "int64", "d2": "float64"}

    def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in nothing}).astype(nothing)

    def among(ss: pd.DataFrame) -> pd.DataFrame:
        ids, x = ss["point"].to_numpy(), np.stack(ss["v"])
        return joined(_bucket_pairs(ids, x, ids, x, k, 2 * bucket, int(ss["tab"].iloc[0])))

    def between(qs: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ss):
            return joined([])
        return joined(_bucket_pairs(qs["point"].to_numpy(), np.stack(qs["v"]), ss["point"].to_numpy(), np.stack(ss["v"]),
                                    k, 2 * bucket, int(ss["tab"].iloc[0])))

    if queries is None:
        found = hashed(points).groupBy(*keys).applyInPandas(among, pairs)
    else:
        asked = cut(hashed(queries))
        crowd = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBES_PER_TASK)).cast("int").alias("parts"))
        left = asked.join(crowd, keys).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
        held = hashed(points).join(crowd, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left, held = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in [*keys, "part"]], "point", "v", F.col("tab").alias("tab"))
                      for side, d in (("l", left), ("r", held)))
        found = left.groupBy(*[f"l_{c}" for c in [*keys, "part"]]).cogroup(
            held.groupBy(*[f"r_{c}" for c in [*keys, "part"]])).applyInPandas(between, pairs)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "s"))
    near = cut(found.groupBy("q", "s").agg(F.min("d2").alias("d2")).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"))
    # points with too few mates are searched exactly
    full = near.groupBy("q").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).select(F.col("q").alias("point"))
    short = cut((points if queries is None else queries).select("g", "point", "v").join(full, "point", "left_anti"))
    if short.isEmpty():
        return near
    exact = _point_neighbors(points, short, dims, k)
    return near.join(full.withColumnRenamed("point", "q"), "q", "left_semi").unionByName(exact)


def knn_lists(left: DataFrame, features: list[str] | str, k: int, row_id: str, right: DataFrame | None = None,
              tag: str | None = None, within: str | None = None, exclude_self: bool | None = None,
              method: str = "exact") -> DataFrame:
    """Rows of ``left`` with ``nn``: array of (d2, id, tag), nearest first.

    ``method`` is "exact", or "lsh" for approximate lists with bounded work per point.

    ``right`` defaults to ``left``; rows then skip themselves.  ``tag`` is a
    column of the neighbour to bring along, ``within`` restricts neighbours to
    the same group.  Ids are integers and unique.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method}")
    self_join = right is None
    skip = self_join if exclude_self is None else exclude_self
    kk = k + 1 if skip else k

    group = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            F.col(row_id).cast("bigint").alias("id"), _vector(features).alias("v"),
            group.alias("g"),
            (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("tag"))

    points = cut(_points(shaped(left if self_join else right), kk))
    dims = len(features) if not isinstance(features, str) else (
        points.select(F.max(F.size("v"))).first()[0] or 0)
    queries = None if self_join else shaped(left).groupBy("g", "v").agg(F.min("id").alias("point"))
    search = _point_neighbors if method == "exact" else _approximate_neighbors
    near = search(points, queries, dims, kk)
    named = near.join(points.select(F.col("point").alias("s"), "members"), "s")
    lists = named.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform(
        "members", lambda m: F.struct(F.col("d2").alias("d2"), m["id"].alias("id"), m["tag"].alias("tag")))))),
        1, kk).alias("nn"))
    asked = points if self_join else queries
    by_vector = asked.select(F.col("point").alias("q"), F.col("g").alias("_g"), F.col("v").alias("_v")).join(lists, "q")

    keyed = left.withColumns({"_v": _vector(features), "_g": group})
    joined = _attach_lists(keyed, by_vector.drop("q"))
    own = F.filter("nn", lambda x: x["id"] != F.col(row_id)) if skip else F.col("nn")
    return joined.withColumn("nn", F.slice(F.coalesce(own, F.array()), 1, k)).select(*left.columns, "nn")


def _attach_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Join on (group, vector); vectors of very many rows are joined without moving those rows."""
    on = ["_h", "_g", "_v"]
    rows, lists = (d.withColumn("_h", F.xxhash64("_g", "_v")) for d in (rows, lists))
    total = rows.count()
    hot = []
    if total > HOT_ROWS:
        # fewer than HOT_SHARE keys can pass, so the list is bounded
        sizes = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("c"))
        hot = [r["_h"] for r in sizes.where(F.col("c") > max(total // HOT_SHARE, HOT_ROWS)).collect()]
    if not hot:
        return rows.join(lists, on, "left")
    is_hot = F.col("_h").isin(hot)
    calm = rows.where(~is_hot).join(lists.where(~is_hot), on, "left")
    busy = rows.where(is_hot).join(F.broadcast(lists.where(is_hot)), on, "left")
    return calm.unionByName(busy)


def knn_join(left: DataFrame, features: list[str] | str, k: int, row_id: str, right: DataFrame | None = None,
             within: str | None = None, method: str = "exact") -> DataFrame:
    """(id, nn_rank, nn_id, distance): the k nearest neighbours, self excluded."""
    lists = knn_lists(left, features, k, row_id, right=right, within=within, method=method)
    return lists.select(row_id, F.posexplode("nn").alias("_p", "_n")).select(
        row_id, (F.col("_p") + 1).alias("nn_rank"), F.col("_n.id").alias("nn_id"), F.sqrt("_n.d2").alias("distance"))
