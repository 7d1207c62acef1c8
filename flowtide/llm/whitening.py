"""Embedding whitening by FEAST contour integration.

Components are turned into integers x = floor(scale * c).  The fit list is each
different vector once.  Its moments are integers as well: tasks add up vectors
for the mean, then products of vectors shifted by the rounded mean, and what the
rounding left over is taken off exactly, so the covariance is the correctly
rounded one, whatever the order of the sums.

The largest eigenvalues are located by inertia: the signs of a symmetric
elimination of V - s I count the eigenvalues above s, and bisection on s parts
them into intervals with one eigenvalue, or one cluster, each.  For an interval
the resolvent (z I - V)^-1, integrated along a circle through its ends with
Gauss-Legendre points, projects a block of vectors onto the wanted directions;
Rayleigh-Ritz on the block gives pairs, and rounds go on until the residuals are
at rounding level.  The pairs found inside the interval must be as many as the
inertia counts say, otherwise the block grows.  A last Rayleigh-Ritz over all
intervals makes the components orthonormal.

Only matrices of the vectors' length meet in one place: one task per vector
length finds the components, and the driver holds them.

Defined results: a vector that is null or holds a null or non-finite component
takes no part; vectors of different lengths are fitted apart; a null id stays a
row; repeated rows count once for the fit and give a row each; an eigenvalue at
rounding level of the largest is no component, so equal or missing vectors give
no rows; components beyond a long are held at its ends, and a deviation beyond a
long is null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import pick
from flowtide.session import cut

SCALE = 256
COMPONENTS = 4
# Points on the upper half of a contour.
POINTS = 8
ROUNDS = 60
LONG = 2**63 - 1


def integer_rows(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec: the rows that take part."""
    v = pick(vectors, id_col, vector_col).toDF("vec_id", "raw")
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("raw").isNotNull()).filter(sound).select("vec_id", F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vec"))


def _by_length(batch: pa.RecordBatch, column: int):
    """(length, row numbers, matrix) for the list column of a batch."""
    lists = batch.column(column)
    size = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[(starts[rows][:, None] + np.arange(d)).reshape(-1)].reshape(len(rows), d)


def _product(x: np.ndarray) -> np.ndarray:
    """x' x in integers: in doubles where every sum stays below 2^53, else in Python integers."""
    if float(np.abs(x.astype(float)).max(initial=0.0)) ** 2 * max(len(x), 1) < 2**53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def _flat(values) -> list[str]:
    """Each integer as its high part and its low 62 bits, whose sums stay within a decimal."""
    return [str(part) for v in values for part in (int(v) >> 62, int(v) & (2**62 - 1))]


def _whole(parts) -> list[int]:
    return [(int(h) << 62) + int(low) for h, low in zip(parts[::2], parts[1::2])]


def _sums(batches):
    """dim, row (-1), n, values: the number and the sums of a task's vectors, as decimal text."""
    held: dict[int, list] = {}
    for b in batches:
        for d, rows, x in _by_length(b, 0):
            s = x.sum(axis=0) if np.abs(x.astype(float)).max(initial=0.0) * len(x) < 2**62 else x.astype(object).sum(axis=0)
            n, before = held.get(d, (0, 0))
            held[d] = n + len(rows), before + s.astype(object)
    for d, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([-1], pa.int32()), pa.array([n], pa.int64()), pa.array([_flat(s)], pa.list_(pa.string()))], names=["dim", "row", "n", "values"])


class _Products:
    """dim, row, n, values: a task's sums of products of vectors shifted by the rounded mean, upper half by rows."""

    def __init__(self, shift):
        self.shift = shift

    def __call__(self, batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_length(b, 0):
                m = self.shift[d]
                wide = np.abs(x.astype(float)).max(initial=0.0) > 2**62 or any(abs(v) > 2**62 for v in m)
                y = x.astype(object) - np.array(m, dtype=object) if wide else x - np.array(m, dtype=np.int64)
                held[d] = held.get(d, 0) + _product(y)
        for d, g in held.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([0], pa.int64()), pa.array([_flat(g[i, i:])], pa.list_(pa.string()))], names=["dim", "row", "n", "values"])


PARTS = "dim int, row int, n long, values array<string>"


def _added(parts: DataFrame) -> DataFrame:
    """dim, row, n, values: the tasks' parts added up, exactly."""
    one = parts.select("dim", "row", "n", F.posexplode("values").alias("at", "v"))
    sums = one.groupBy("dim", "row", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"].cast("string"))
    return sums.groupBy("dim", "row").agg(F.max("n").alias("n"), values.alias("values"))


def inertia(v: np.ndarray, s: float) -> int:
    """Eigenvalues of the symmetric matrix ``v`` above ``s``, by the pivot signs of a symmetric elimination.

    The largest diagonal entry is the pivot; where all are small beside the
    largest entry a 2 x 2 block is, which has one eigenvalue of each sign.
    """
    a = v - s * np.eye(len(v))
    least = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    above = 0
    while len(a):
        diag = np.abs(np.diag(a))
        p = int(diag.argmax())
        r, c = np.unravel_index(np.abs(a).argmax(), a.shape)
        if max(diag[p], abs(a[r, c])) <= least:
            return above  # the rest is zero: eigenvalues at s
        if diag[p] >= 0.64 * abs(a[r, c]):
            keep = np.arange(len(a)) != p
            col, pivot = a[keep, p], a[p, p]
            above += pivot > 0
            a = a[np.ix_(keep, keep)] - np.outer(col, col) / pivot
        else:
            keep = (np.arange(len(a)) != r) & (np.arange(len(a)) != c)
            cols, block = a[np.ix_(keep, [r, c])], a[np.ix_([r, c], [r, c])]
            above += 1
            a = a[np.ix_(keep, keep)] - cols @ np.linalg.solve(block, cols.T)
    return above


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of disjoint intervals that hold the k largest eigenvalues and all equal to the k-th.

    An interval holds one eigenvalue, or a cluster no wider than the rounding level.
    """
    high = float(np.abs(v).sum(axis=1).max(initial=0.0)) * (1 + 1e-9)
    narrow = high * 1e-11
    low, top = high * len(v) * np.finfo(float).eps, high  # what lies below is rounding
    found = inertia(v, low)
    if found > k:
        while top - low > narrow and found != k:
            mid = (low + top) / 2
            n = inertia(v, mid)
            if n >= k:
                low, found = mid, n
            else:
                top = mid
    out, open_ = [], [(low, high, found)]
    while open_:
        a, b, n = open_.pop()
        if n == 0:
            continue
        if b - a <= narrow or (n == 1 and b - a <= 0.5 * abs(b)):
            out.append((a, b, n))
            continue
        mid = (a + b) / 2
        upper = inertia(v, mid) - inertia(v, b) if b < high else inertia(v, mid)
        open_ += [(a, mid, n - upper), (mid, b, upper)]
    return sorted(out, reverse=True)


def feast(v: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``v`` in [low, high], which inertia says holds ``wanted`` of them."""
    d = len(v)
    width = max(high - low, np.abs(v).sum(axis=1).max() * 1e-9)
    centre, radius = (low + high) / 2, width / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.pi / 2 * (1 - nodes)  # upper half of the circle; the lower half is its conjugate
    scale, rng = np.abs(v).sum(axis=1).max(), np.random.default_rng(13)
    block = min(d, wanted + 6)
    while True:
        y = rng.standard_normal((d, block))
        last = np.inf
        for _ in range(ROUNDS):
            q = np.zeros_like(y)
            for w, t in zip(weights, turns):
                step = radius * np.exp(1j * t)
                q += w / 2 * (step * np.linalg.solve((centre + step) * np.eye(d) - v, y.astype(complex))).real
            basis, size, _ = np.linalg.svd(q, full_matrices=False)
            basis = basis[:, size > size[0] * 1e-14]
            values, turn = np.linalg.eigh(basis.T @ v @ basis)
            x = basis @ turn
            inside = np.flatnonzero((values >= centre - radius * (1 + 1e-6)) & (values <= centre + radius * (1 + 1e-6)))
            residual = np.abs(v @ x[:, inside] - x[:, inside] * values[inside]).max(initial=0.0)
            if len(inside) >= wanted and (residual <= 1e-13 * scale or (residual <= 1e-9 * scale and residual >= last / 2)):
                best = inside[np.argsort(np.abs(values[inside] - centre), kind="stable")][:wanted]
                return values[best], x[:, best]
            last = residual if len(inside) >= wanted else np.inf
            y = x if x.shape[1] == block else np.hstack([x, rng.standard_normal((d, block - x.shape[1]))])
        if block == d:
            raise ArithmeticError("no agreement between the projected pairs and the inertia count")
        block = min(d, 2 * block)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns; none at rounding level."""
    scale = float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    a = v / scale
    blocks = [feast(a, low, high, n)[1] for low, high, n in intervals(a, k)]
    basis, size, _ = np.linalg.svd(np.hstack(blocks), full_matrices=False)
    if size.min() < 0.5:
        raise ArithmeticError("two intervals gave the same direction")
    values, turn = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > values.max() * len(v) * np.finfo(float).eps]
    return values[order] * scale, basis @ turn[:, order]


class _Fit:
    """One row per component of a vector length, from its integer sums."""

    def __init__(self, k, totals):
        self.k, self.totals = k, totals

    def __call__(self, parts: pd.DataFrame) -> pd.DataFrame:
        d = int(parts["dim"].iloc[0])
        n, sums, shift = self.totals[d]
        rest = [s - n * m for s, m in zip(sums, shift)]
        v = np.empty((d, d))
        for row, values in zip(parts["row"], parts["values"]):
            for i, g in enumerate(_whole(values), start=row):
                v[row, i] = v[i, row] = (n * g - rest[row] * rest[i]) / (n * n)
        e, x = components(v, self.k)
        trace = float(np.trace(v))
        out = [(d, i + 1, float(e[i]), float(e[i]) / trace, x[:, i].tolist()) for i in range(len(e))]
        return pd.DataFrame(out, columns=["dim", "component", "eigenvalue", "explained", "direction"])


class _Whitened:
    """vec_id, component, deviation and whitened values of a task's rows."""

    def __init__(self, totals, found, with_id=True):
        self.totals, self.found, self.with_id = totals, found, with_id

    def project(self, d, x):
        n, sums, shift = self.totals[d]
        mean = np.array([(s - n * m) / n for s, m in zip(sums, shift)])
        wide = np.abs(x.astype(float)).max(initial=0.0) > 2**52 or any(abs(m) > 2**52 for m in shift)
        y = (x.astype(object) - np.array(shift, dtype=object)).astype(float) if wide else (x - np.array(shift, dtype=np.int64)).astype(float)
        e = np.array([r[0] for r in self.found[d]])
        directions = np.array([r[2] for r in self.found[d]]).T
        return (y - mean) @ directions / np.sqrt(e)

    def deviation(self, d, x):
        n, sums, _ = self.totals[d]
        most = n * float(np.abs(x.astype(float)).max(initial=0.0)) + max((abs(s) for s in sums), default=0)
        if most**2 * d < 2**62:
            y = n * x - np.array(sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * x.astype(object) - np.array(sums, dtype=object)
        return [s if s <= LONG else None for s in (y * y).sum(axis=1)]

    def __call__(self, batches):
        for b in batches:
            for d, rows, x in _by_length(b, 1):
                found = self.found.get(d, [])
                if not found:
                    continue
                k, z, away = len(found), self.project(d, x), self.deviation(d, x)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                        pa.array([self.totals[d][0]] * (k * len(rows)), pa.int64()), pa.array([a for a in away for _ in range(k)], pa.int64()),
                        pa.array(z.reshape(-1)), pa.array([r[1] for r in found] * len(rows)), pa.array([d] * (k * len(rows)), pa.int32()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "dim"])


class _Wide(_Whitened):
    """dim and one column per component of the fit list, for the check of the result."""

    def __init__(self, totals, found, k):
        super().__init__(totals, found)
        self.k = k

    def __call__(self, batches):
        for b in batches:
            for d, _, x in _by_length(b, 0):
                if self.found.get(d):
                    z = self.project(d, x)
                    cols = [pa.array(z[:, i]) if i < z.shape[1] else pa.nulls(len(x), pa.float64()) for i in range(self.k)]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), *cols], names=["dim", *[f"z{i}" for i in range(self.k)]])


def fit(rows: DataFrame, k: int = COMPONENTS):
    """(totals, found, errors) by vector length from rows of integer vectors.

    totals: n, sums, rounded means; found: (eigenvalue, explained, direction) per
    component; errors: largest entry of the whitened covariance minus the identity.
    All are as large as the vectors are long and come to the driver.
    """
    each = cut(rows.filter(F.size("vec") > 0).select("vec").distinct())
    totals = {}
    for r in _added(each.mapInArrow(_sums, PARTS)).collect():
        sums = _whole(r["values"])
        totals[r.dim] = r.n, sums, [(2 * s + r.n) // (2 * r.n) for s in sums]
    parts = _added(each.mapInArrow(_Products({d: t[2] for d, t in totals.items()}), PARTS))
    found: dict[int, list] = {}
    solve = _Fit(k, totals)
    schema = "dim int, component int, eigenvalue double, explained double, direction array<double>"
    for r in sorted(parts.groupBy("dim").applyInPandas(lambda g: solve(g), schema).collect(), key=lambda r: r.component):
        found.setdefault(r.dim, []).append((r.eigenvalue, r.explained, list(r.direction)))
    wide = each.mapInArrow(_Wide(totals, found, k), ", ".join(["dim int", *[f"z{i} double" for i in range(k)]]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    off = [F.abs(F.covar_pop(f"z{i}", f"z{j}") - (1.0 if i == j else 0.0)) for i, j in pairs]
    errors = {r.dim: r.error for r in wide.groupBy("dim").agg(F.greatest(*off, F.lit(0.0)).alias("error")).collect()}
    return totals, found, errors


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row that takes part."""
    rows = integer_rows(vectors, scale, id_col, vector_col)
    totals, found, errors = fit(rows, k)
    kind = dict(rows.dtypes)["vec_id"]
    out = rows.mapInArrow(_Whitened(totals, found), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, dim int")
    error = F.element_at(F.create_map(*[F.lit(x) for d, e in errors.items() for x in (d, e)]), F.col("dim")) if errors else F.lit(None).cast("double")
    return out.withColumn("identity_error", error).drop("dim")
