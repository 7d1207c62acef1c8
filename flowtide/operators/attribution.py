"""Exact per-row feature attributions of a boosted-tree model.

For one leaf with value v and the distinct features F on its path, let o_i be
1 if the row meets every split on feature i (else 0) and r_i the product of
the cover ratios of those splits.  The path-dependent game of the leaf is
v * prod(o_i, i in S) * prod(r_i, i not in S), so its Shapley values depend on
the row only through the 0/1 pattern o and are found in time quadratic in the
depth (``leaf_values``).  Summing over leaves and trees gives the attributions of
the model margin.

The trees live in the driver anyway (a fitted model is local); their leaf list
is broadcast and the rows are scored where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import class_name
from flowtide.operators.features import assemble_features
from flowtide.session import scratch_path


def model_leaves(model, spark, path: str | None = None) -> list[tuple]:
    """(value, [(feature, low, high, ratio)]) per leaf, read from the saved form of the model."""
    path = path or scratch_path(spark, "model")
    model.write().overwrite().save(path)
    node = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    weights = list(model.treeWeights)
    trees: dict[int, dict[int, tuple]] = {}
    for r in node.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves = []
    for tree_id, nodes in trees.items():
        stack = [(0, {})]
        while stack:
            i, path_so_far = stack.pop()
            r = nodes[i]
            if r["leftChild"] < 0:
                leaves.append((r["prediction"] * weights[tree_id],
                               [(f, *b) for f, b in sorted(path_so_far.items())]))
                continue
            f, t = r["feature"], r["threshold"]
            low, high, ratio = path_so_far.get(f, (-np.inf, np.inf, 1.0))
            for child, b in ((r["leftChild"], (low, min(high, t))), (r["rightChild"], (max(low, t), high))):
                share = nodes[child]["rawCount"] / r["rawCount"]
                stack.append((child, {**path_so_far, f: (*b, ratio * share)}))
    return leaves


def attribution_bias(leaves: list[tuple]) -> float:
    """The expected margin: what the attributions of a row do not account for."""
    return float(sum(v * np.prod([p[3] for p in path]) for v, path in leaves))


def leaf_values(value: float, o: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf, a row per 0/1 pattern ``o`` and a column per feature of its path.

    With the multilinear extension of the game, feature i gets
    value * (o_i - r_i) * integral over t of prod(t o_j + (1 - t) r_j, j other than i).
    The integrand has degree m - 1, so ceil(m / 2) Gauss-Legendre points are
    exact: m * m / 2 products per pattern instead of one per subset.
    """
    m = len(ratios)
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = ((nodes + 1) / 2)[:, None, None]
    terms = t * o + (1 - t) * ratios                     # points x patterns x features
    before, after = np.ones_like(terms), np.ones_like(terms)
    np.cumprod(terms[..., :-1], axis=2, out=before[..., 1:])
    after[..., :-1] = np.cumprod(terms[..., :0:-1], axis=2)[..., ::-1]
    return value * (o - ratios) * np.tensordot(weights / 2, before * after, axes=1)


def _attribute(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Attributions of the rows of ``x``; a leaf is worked out for the patterns that occur only."""
    phi = np.zeros_like(x)
    for value, path in leaves:
        if not path:
            continue
        m = len(path)
        code = np.zeros(len(x), dtype=np.int64)
        for i, (f, low, high, _) in enumerate(path):
            code |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << i
        if m <= 12:
            seen = np.flatnonzero(np.bincount(code, minlength=1 << m))
            place = np.zeros(1 << m, dtype=np.int64)
            place[seen] = np.arange(len(seen))
            where = place[code]
        else:
            seen, where = np.unique(code, return_inverse=True)
        o = ((seen[:, None] >> np.arange(m)) & 1).astype(float)
        phi[:, [p[0] for p in path]] += leaf_values(value, o, np.array([p[3] for p in path]))[where]
    return phi


def feature_attribution(model, df: DataFrame, row_id: str = "flow_id", features: list[str] | None = None,
                        leaves: list[tuple] | None = None) -> DataFrame:
    """(id, feature, phi) per row and feature of a boosted model; the bias term is left out.

    A one-vs-rest model gives (id, class, feature, phi), for the margin of every class.
    """
    cols = features or S.GOLDEN12
    spark = df.sparkSession
    many = isinstance(model, OneVsRestModel)
    parts = [model_leaves(m, spark) for m in model.models] if many else [leaves or model_leaves(model, spark)]
    shared = spark.sparkContext.broadcast(parts)
    id_type = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[cols].to_numpy(dtype=float)
            for code, part in enumerate(shared.value):
                out = pd.DataFrame(_attribute(x, part), columns=[f"phi_{c}" for c in cols])
                out.insert(0, "code", code)
                out.insert(0, row_id, b[row_id].to_numpy())
                yield out

    wide = df.select(row_id, *cols).mapInPandas(
        run, ", ".join([f"{row_id} {id_type}", "code int"] + [f"phi_{c} double" for c in cols]))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"phi_{c}").alias("phi")) for c in cols])
    keys = [F.col(row_id), class_name(F.col("code")).alias("class")] if many else [F.col(row_id)]
    return wide.select(*keys, F.inline(pairs))


def attribute_models(models: dict, df: DataFrame, row_id: str = "flow_id", features: list[str] | None = None) -> DataFrame:
    """(model, id, [class,] feature, phi) of several models, as ``mean_abs_attribution`` and ``attribution_shift`` take them."""
    rows = [feature_attribution(m, df, row_id, features).select(F.lit(name).alias("model"), "*") for name, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def additivity_error(model, df: DataFrame, row_id: str = "flow_id", features: list[str] | None = None) -> DataFrame:
    """(rows, error): largest difference between a row's margin and its attributions plus the bias."""
    leaves = model_leaves(model, df.sparkSession)
    sums = feature_attribution(model, df, row_id, features, leaves).groupBy(row_id).agg(F.sum("phi").alias("s"))
    margins = model.transform(assemble_features(df)).select(row_id, vector_to_array("rawPrediction")[1].alias("m"))
    gap = F.abs(F.col("s") + attribution_bias(leaves) - F.col("m"))
    return sums.join(margins, row_id).agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("error"))
