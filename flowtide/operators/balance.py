"""Class balancing: downsample, synthesise, interpolate, clean."""

from __future__ import annotations

import functools
import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.functions import hash_unit
from flowtide.operators.neighbors import knn_lists
from flowtide.operators.ordering import BLOCK, ordered_blocks, rank_within, running_sum
from flowtide.operators.sampling import downsample_majority
from flowtide.operators.setops import union_sources
from flowtide.session import cut, small_table

GRID = 1024         # knots of a quantile grid, per class and feature
CHUNK = 10_000      # new rows made at a time


def _small_classes(df: DataFrame, label: str, below: int) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return small_table(counts.where((F.col("_n") < below) & F.col(label).isNotNull()))


def _chunks(small: DataFrame, label: str, target: int) -> DataFrame:
    """(label, _n, _from, _to): ranges of draw numbers, dealt over tasks."""
    pieces = small.select(label, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(target - 1) - F.col("_n"), F.lit(CHUNK).cast("bigint"))).alias("_from"))
    ranges = pieces.withColumn("_to", F.least(F.col("_from") + CHUNK, F.lit(target) - F.col("_n")))
    n = small.agg(F.sum(F.ceil((F.lit(target) - F.col("_n")) / CHUNK))).first()[0] or 1
    return ranges.repartition(min(int(n), 10_000), label, "_from")


def new_row_id(label: Column, kind: str, j: Column) -> Column:
    """Negative id from a hash, apart from all real ids."""
    h = F.md5(F.concat_ws("|", label, F.lit(kind), j.cast("string")))
    return -F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") - 1


@functools.cache
def _normal_grid():
    z = np.linspace(-6.0, 6.0, 4001)
    return z, np.array([NormalDist().cdf(v) for v in z])


@F.pandas_udf(T.DoubleType())
def _normal_score(share: pd.Series) -> pd.Series:
    z, p = _normal_grid()
    return pd.Series(np.interp(share, p, z))


def value_ranks(rows: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """(label, _n, _f, _v, _c, _last): every value of every class and feature with its count and its last rank."""
    cells = rows.select(label, "_n", F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_f", "_v"))
    cells = cells.groupBy(label, "_n", "_f", "_v").agg(F.count(F.lit(1)).alias("_c"))
    blocks = ordered_blocks(cells, [label, "_f", "_v"])
    return cut(running_sum(blocks, [label, "_f"], ["_v"], F.col("_c"), "_last").drop(BLOCK))


def quantile_grids(ranks: DataFrame, label: str) -> DataFrame:
    """(label, _f, values): the values at the shares 0, 1/GRID, ... 1, linear between neighbouring order statistics.

    Order statistic i (from 0) stands at (i + 0.5) / n; the ends keep the least and the largest value.
    """
    n, first, last = F.col("_n"), F.col("_last") - F.col("_c"), F.col("_last") - 1
    knot = lambda i: F.ceil((i + 0.5) * GRID / n)  # noqa: E731  first knot at or after order statistic i
    low_from = F.when(first == 0, 0).otherwise(knot(first))
    low_to = F.when(last == n - 1, GRID).otherwise(knot(last + 1) - 1)
    # the upper neighbour of a knot is the statistic after its lower one
    up_from = F.when(first == 0, 0).otherwise(knot(first - 1))
    up_to = F.when(last == n - 1, GRID).otherwise(knot(last) - 1)

    def reached(a, b, name):
        span = F.when(a <= b, F.sequence(a.cast("bigint"), b.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return ranks.select(label, "_n", "_f", F.explode(span).alias("g"), F.col("_v").alias(name))

    both = reached(low_from, low_to, "low").join(reached(up_from, up_to, "up"), [label, "_n", "_f", "g"])
    place = F.greatest(F.col("g") * n / GRID - 0.5, F.lit(0.0))
    value = F.col("low") + (place - F.floor(place)) * (F.col("up") - F.col("low"))
    return both.select(label, "_f", "g", value.alias("v")).groupBy(label, "_f").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("g", "v"))), lambda x: x["v"]).alias("values"))


def score_correlations(rows: DataFrame, ranks: DataFrame, row_id: str, label: str, cols: list[str]) -> DataFrame:
    """(label, c_i_j ...): correlations of the normal scores of mean ranks, per class."""
    scored = ranks.select(F.col(label).alias("_l"), F.col("_f").alias("_g"), F.col("_v").alias("_w"),
                          _normal_score((F.col("_last") - F.col("_c") / 2.0) / F.col("_n")).alias("_z"))
    long = rows.select(row_id, label, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_f", "_v"))
    joined = long.join(scored, (F.col(label) == F.col("_l")) & (F.col("_f") == F.col("_g")) & (F.col("_v") == F.col("_w")))
    wide = joined.groupBy(row_id, label).agg(*[F.max(F.when(F.col("_f") == i, F.col("_z"))).alias(f"z{i}") for i in range(len(cols))])

    def corr(a, b):  # null without spread
        return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))

    return wide.groupBy(label).agg(*[corr(f"z{i}", f"z{j}").alias(f"c_{i}_{j}") for i in range(len(cols)) for j in range(i)])


def _factor(row, d: int) -> np.ndarray:
    """A matrix whose product with its transpose is the correlation; features without spread stand alone."""
    corr = np.eye(d)
    for i in range(d):
        for j in range(i):
            c = row[f"c_{i}_{j}"]
            corr[i, j] = corr[j, i] = 0.0 if c is None or np.isnan(c) else c
    w, q = np.linalg.eigh(corr)
    return q * np.sqrt(np.clip(w, 0.0, None))


def synthesize_minority(df: DataFrame, row_id: str, label: str = "unified_label", features: list[str] | None = None,
                        threshold: int = 50_000, target: int = 20_000, seed: int = 42) -> DataFrame:
    """Synthetic rows for classes below ``threshold`` and ``target``: (id, features, label, origin).

    A Gaussian copula per class stands in for a generative network.  Ranks are
    exact and taken over range blocks, correlations are aggregates, and quantile
    grids of ``GRID`` knots map draws back to values.  What the driver holds is a
    few numbers per class; rows and draws of a class spread over tasks.  A draw
    depends on the seed, the class and its number only.  Rows with a missing
    feature teach nothing about that feature's neighbours and are left out.
    """
    cols = features or S.GOLDEN12
    whole = df.select(row_id, label, *cols).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in cols))
    small = _small_classes(whole, label, min(threshold, target))
    rows = cut(whole.join(small, label))
    ranks = value_ranks(rows, label, cols)
    grids = {(r[label], r["_f"]): np.array(r["values"]) for r in quantile_grids(ranks, label).collect()}
    factors = {r[label]: _factor(r, len(cols)) for r in score_correlations(rows, ranks, row_id, label, cols).collect()}
    shared = df.sparkSession.sparkContext.broadcast((grids, factors))
    out = T.StructType([T.StructField(label, T.StringType()), T.StructField("_j", T.LongType()),
                        *[T.StructField(c, T.DoubleType()) for c in cols]])

    def draw(batches):
        grids, factors = shared.value
        z, p = _normal_grid()
        shares = np.arange(GRID + 1) / GRID
        for b in batches:
            for name, start, stop in b[[label, "_from", "_to"]].itertuples(index=False, name=None):
                rng = np.random.default_rng([seed, zlib.crc32(name.encode()), start])
                u = np.interp(rng.standard_normal((stop - start, len(cols))) @ factors[name].T, z, p)
                new = pd.DataFrame({c: np.interp(u[:, i], shares, grids[name, i]) for i, c in enumerate(cols)})
                new.insert(0, "_j", np.arange(start, stop))
                new.insert(0, label, name)
                yield new

    drawn = _chunks(small, label, target).mapInPandas(draw, out)
    return drawn.select(new_row_id(F.col(label), "copula", F.col("_j")).alias(row_id), *cols, label,
                        F.lit("copula").alias("origin"))


def smote(df: DataFrame, row_id: str, label: str = "unified_label", features: list[str] | None = None,
          target: int = 20_000, k: int = 5, seed: int = 42, method: str = "exact") -> DataFrame:
    """Interpolated rows x + u (nn - x) for classes below ``target``.

    Result: (id, features, label, origin, base_id, nn_id, u).  Base row,
    neighbour and u come from hashes of (class, draw number), so a rerun gives
    the same rows.  A class of one row has no neighbour and gets none.
    """
    cols = features or S.GOLDEN12
    small = _small_classes(df, label, target)
    rows = df.select(row_id, label, *cols).join(small, label)  # one row per class
    near = knn_lists(rows, cols, k, row_id, within=label, method=method)
    base = rank_within(near, [label], [row_id], "_pos").withColumn("_pos", (F.col("_pos") - 1).cast("bigint"))
    key = F.concat_ws("|", F.col(label), F.col("_j").cast("string"))
    draws = _chunks(small, label, target).select(label, "_n", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_j"))
    draws = draws.select(label, "_j", F.floor(hash_unit(key, seed) * F.col("_n")).alias("_pos"),
                         hash_unit(key, seed + 1).alias("_pick"), hash_unit(key, seed + 2).alias("u"))
    chosen = draws.join(base.drop("_n"), [label, "_pos"]).where(F.size("nn") > 0).withColumn(
        "nn_id", F.get("nn", F.floor(F.col("_pick") * F.size("nn")).cast("int"))["id"])
    other = rows.select(F.col(row_id).alias("nn_id"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    pair = chosen.join(other, "nn_id")
    return pair.select(
        new_row_id(F.col(label), "smote", F.col("_j")).alias("_new"), F.col(row_id).alias("base_id"), "nn_id", "u",
        *[(F.col(c) + F.col("u") * (F.col(f"_b_{c}") - F.col(c))).alias(c) for c in cols],
        label, F.lit("smote").alias("origin")).withColumnRenamed("_new", row_id)


def enn_clean(df: DataFrame, row_id: str, label: str = "unified_label", features: list[str] | None = None,
              k: int = 3, scale: bool = False, method: str = "exact") -> DataFrame:
    """Drop rows whose k nearest neighbours are not all of their own class.

    The smallest class is left alone.  ``scale`` standardises the features
    before measuring distances; ``method`` is that of the neighbour join.
    """
    cols = features or S.GOLDEN12
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by(label, F.struct("n", label))).scalar()
    work = df
    if scale:
        stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols]).first()
        work = df.withColumns({f"_z_{c}": (F.col(c) - stats[c]["m"]) / (stats[c]["s"] or 1.0) for c in cols})
        cols = [f"_z_{c}" for c in cols]
    near = knn_lists(work, cols, k, row_id, tag=label, method=method)
    agree = F.forall("nn", lambda x: x["tag"] == F.col(label))
    return near.where((F.col(label) == smallest) | agree).select(*df.columns)


def balance_dataset(df: DataFrame, row_id: str, label: str = "unified_label", majority_target: int = 300_000,
                    threshold: int = 50_000, target: int = 20_000, k: int = 3, seed: int = 42, smote_target: int | None = None):
    """Downsample, synthesise, interpolate, clean. Returns (rows, report of class counts per stage).

    Classes below ``threshold`` are synthesised up to ``target``; interpolation then
    fills whatever class is still below ``smote_target``, by default ``target`` as
    well.  With a threshold above both, as in the defaults, nothing is left for it.
    """
    base = df.select(row_id, *S.GOLDEN12, label, F.lit("real").alias("origin"))
    stages = [("input", base)]
    down = cut(downsample_majority(base, row_id, label, target=majority_target, seed=seed))
    stages.append(("downsampled", down))
    synth = cut(union_sources(down, synthesize_minority(down, row_id, label, None, threshold, target, seed)))
    stages.append(("synthesized", synth))
    added = smote(synth, row_id, label, target=target if smote_target is None else smote_target, seed=seed).select(*base.columns)
    full = cut(union_sources(synth, added))
    stages.append(("smote", full))
    clean = cut(enn_clean(full, row_id, label, k=k))
    stages.append(("cleaned", clean))
    report = None
    for i, (name, part) in enumerate(stages):
        counts = part.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), label, "rows")
        report = counts if report is None else report.unionAll(counts)
    return clean, report
