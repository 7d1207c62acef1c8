"""Exact interpolated quantiles without holding a group in one task's memory.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here a sketch first brackets each wanted rank, then one
counting pass keeps only the values inside the brackets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide.session import small_table

ACCURACY = 20_000           # sketch: rank error below n / ACCURACY
MARGIN = 4 / ACCURACY       # half width of a bracket, four times that error
SMALL_GROUP = 100_000       # up to here the bracket is the whole group


def _bounds(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    lo = [max(p - MARGIN, 0.0) for p in probs]
    hi = [min(p + MARGIN, 1.0) for p in probs]
    c = F.col(value)
    stats = df.where(c.isNotNull()).groupBy(*groups).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.stddev_samp(c).alias("std"), F.percentile_approx(c, lo + hi, ACCURACY).alias("_q"))
    k = len(probs)
    small = F.col("n") <= SMALL_GROUP
    edges = []
    for i, p in enumerate(probs):
        lower = F.when(small | F.lit(lo[i] <= 0.0), F.col("min")).otherwise(F.col("_q")[i])
        upper = F.when(small | F.lit(hi[i] >= 1.0), F.col("max")).otherwise(F.col("_q")[k + i])
        pos = (F.col("n") - 1) * F.lit(p)
        edges.append(F.struct(F.lit(i).alias("i"), lower.alias("lo"), upper.alias("hi"), pos.alias("pos")))
    return stats.withColumn("_edges", F.array(*edges)).drop("_q")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    """Per group: n, mean, min, max, std and ``q``, the array of exact quantiles.

    Interpolation is linear between the two neighbouring ranks.
    """
    stats = small_table(_bounds(df, groups, value, probs))
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    keyed = _attach(rows, stats.select(*groups, "_edges"), groups)
    # per wanted rank: rows below its bracket fold into one null key, rows
    # above are not needed, rows inside are counted per value
    def cell(i):
        edge = F.col("_edges")[i]
        return F.when(F.col("_v") <= edge["hi"], F.struct(
            F.lit(i).alias("_i"), F.when(F.col("_v") >= edge["lo"], F.col("_v")).alias("_x")))

    cells = keyed.select(*groups, F.explode(F.array(*[cell(i) for i in range(len(probs))])).alias("_e"))
    counts = cells.where(F.col("_e").isNotNull()).groupBy(
        *groups, F.col("_e._i").alias("_i"), F.col("_e._x").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*groups, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_c").over(upto))
    ranked = _attach(ranked, stats.select(*groups, "_edges"), groups).withColumn("_pos", F.col("_edges")[F.col("_i")]["pos"])

    def at(rank):
        here = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("_x")))

    low, high = F.floor("_pos"), F.ceil("_pos")
    picked = ranked.groupBy(*groups, "_i").agg(
        at(low).alias("_a"), at(high).alias("_b"), F.max(F.col("_pos") - low).alias("_f"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    # a rank outside its bracket would leave a null; fail instead of guessing
    safe = F.when(F.col("_a").isNull() | F.col("_b").isNull(),
                  F.raise_error(F.lit("rank outside its bracket"))).otherwise(value_at)
    q = picked.select(*groups, "_i", safe.alias("_y")).groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_y"))), lambda s: s["_y"]).alias("q"))
    base = stats.drop("_edges")
    return _on_groups(q, base, groups) if groups else base.withColumn("q", q.scalar())


def _attach(rows: DataFrame, small: DataFrame, groups: list[str]) -> DataFrame:
    """Group-level values onto rows; the ungrouped case needs no join."""
    if groups:
        return _on_groups(rows, small, groups)
    return rows.withColumn("_edges", small.select("_edges").scalar())


def _on_groups(rows: DataFrame, small: DataFrame, groups: list[str]) -> DataFrame:
    """Inner join that keeps a null group."""
    other = small.withColumnsRenamed({g: f"_of_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    return rows.join(other, same).drop(*[f"_of_{g}" for g in groups])
