"""Reproducible samples and splits by hash order.

Exact sizes come from cut points in hash order, not from a sort of all rows:
count rows per hash prefix, find the prefix in which each cut falls, rank only
the rows of those prefixes, then decide every row by comparison.  The full
table is scanned, never shuffled; a class that holds most rows is no hot spot,
because the hash spreads it over the prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide import schema as S
from flowtide.functions import hash_key, hash_unit
from flowtide.session import cut, small_table

PREFIX_HEX = 4  # 65,536 prefixes


def hash_cuts(df: DataFrame, row_id: str, seed: int, parts_per_mille: list[int] | None = None,
              rows: int | None = None, by: str | None = None) -> DataFrame:
    """Per group and cut: the (hash, id) of the last row at or before the cut.

    Cuts are shares of the group in 1/1000 (rounded half up), or one absolute
    number of rows.  A cut of zero rows has no entry.
    """
    return _cuts(df.withColumn("_h", hash_key(row_id, seed)), row_id, parts_per_mille, rows, by)


def _cuts(hashed: DataFrame, row_id: str, parts_per_mille: list[int] | None = None, rows: int | None = None,
          by: str | None = None) -> DataFrame:
    """``hash_cuts`` of rows that carry their hash as ``_h``."""
    group = [by] if by else []
    keyed = hashed.select(*group, F.col(row_id).alias("_id"), "_h").withColumn("_p", F.substring("_h", 1, PREFIX_HEX))
    hist = keyed.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    # at most 65,536 rows per group from here
    part = Window.partitionBy(*group)
    upto = part.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(part)})
    if rows is not None:
        cuts = [F.least(F.lit(rows).cast("bigint"), F.col("_total"))]
    else:
        cuts = [F.floor((F.col("_total") * F.lit(pm) + 500) / 1000) for pm in parts_per_mille]
    at = F.inline(F.array(*[F.struct(F.lit(i).alias("_cut"), c.cast("bigint").alias("_rank"))
                            for i, c in enumerate(cuts)]))
    before = F.col("_upto") - F.col("_n")
    edges = hist.select(*group, "_p", "_n", "_upto", at).where(
        (F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto"))
    ).select(*group, "_p", "_cut", (F.col("_rank") - before).alias("_need"))
    edges = small_table(edges)
    same = keyed["_p"] == edges["_p"]
    if by:
        same = same & keyed[by].eqNullSafe(edges[by])
    near = keyed.join(edges, same).select(*[keyed[g] for g in group], keyed["_p"], "_cut", "_need", "_h", "_id")
    place = F.row_number().over(Window.partitionBy(*group, "_p", "_cut").orderBy("_h", "_id"))
    return near.withColumn("_r", place).where("_r = _need").select(
        *group, F.col("_cut").alias("cut"), F.col("_h").alias("cut_hash"), F.col("_id").alias("cut_id"))


def _not_after(h, i, ch, ci):
    return (h < ch) | ((h == ch) & (i <= ci))


def stratified_split(df: DataFrame, label: str, row_id: str, ratios: dict[str, float], seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Assign every row to a split with exact class counts (shares to 1/1000, rounded half up).

    The rows are stored once with their hash.  The passes that find the cuts read
    three of the stored columns, and the split is a comparison on each later read.
    """
    names, cum, acc = list(ratios), [], 0
    for n in names:
        acc += round(ratios[n] * 1000)
        cum.append(acc)
    if acc != 1000:
        raise ValueError("ratios must add up to 1")
    keyed = cut(df.withColumn("_h", hash_key(row_id, seed)))
    cuts = _cuts(keyed, row_id, parts_per_mille=cum[:-1], by=label)
    at = [f"_cut{i}" for i in range(len(cum) - 1)]
    wide = cuts.groupBy(F.col(label).alias("_label")).agg(F.lit(len(at)).alias("_n"), *[
        F.max(F.when(F.col("cut") == i, F.struct("cut_hash", "cut_id"))).alias(c) for i, c in enumerate(at)])
    joined = keyed.join(small_table(wide), keyed[label].eqNullSafe(F.col("_label")), "left")
    split = None
    for n, c in zip(names, at):
        before = F.coalesce(_not_after(F.col("_h"), F.col(row_id), F.col(c)["cut_hash"], F.col(c)["cut_id"]), F.lit(False))
        split = F.when(before, n) if split is None else split.when(before, n)
    split = split.otherwise(names[-1]) if split is not None else F.lit(names[0])
    return joined.withColumn(out, split).select(*df.columns, out)


def sample_rows(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the first in hash order."""
    last = hash_cuts(df, row_id, seed, rows=n)
    h = last.select("cut_hash").scalar()
    i = last.select("cut_id").scalar()
    return df.where(_not_after(hash_key(row_id, seed), F.col(row_id), h, i))


def downsample_majority(df: DataFrame, row_id: str, label: str = "unified_label", majority: str = S.BENIGN,
                        target: int = 300_000, seed: int = 42) -> DataFrame:
    """Keep about ``target`` rows of the majority class and every other row.

    One count, then a filter: no shuffle of rows.
    """
    n = df.agg(F.count_if(F.col(label) == majority)).scalar()
    fraction = F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), n))
    keep = (F.col(label) != majority) | F.col(label).isNull() | (hash_unit(row_id, seed) < fraction)
    return df.where(keep)
