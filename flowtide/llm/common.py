"""Helpers shared by the operators: narrow inputs, Arrow maps, vectorised byte hashing."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
# One bit per byte value: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; all others, clashing names included, stay out of the operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterable[tuple]], Iterator[tuple]]) -> DataFrame:
    """``fn`` over plain Python tuples, in and out by Arrow batches of bounded size."""
    return df.mapInArrow(_Rows(fn, df.sparkSession.createDataFrame([], schema).schema), schema)


class _Rows:
    """Picklable adapter from tuples to Arrow batches."""

    OUT_ROWS = 20_000
    OUT_BYTES = 8 << 20

    def __init__(self, fn, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.fn, self.schema = fn, to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        held, size = [], 0
        for row in self.fn(rows()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= self.OUT_ROWS or size >= self.OUT_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held):
        cols = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


@functools.lru_cache(maxsize=16)
def _weights(seed: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix_hash(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over random byte weights, and the inverse powers.

    The hash of bytes [s, e) is ``(sums[e] - sums[s]) * inverse[s]`` modulo 2^64.
    """
    n = len(data)
    weights = _weights(seed)
    up = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(weights[data] * up[:n], out=sums[1:])
    return sums, powers(n, inverse=True)


_table: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n + 1 powers of the base (or of its inverse) modulo 2^64."""
    have = _table.get(inverse)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        base = _P_INV if inverse else _P
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _table[inverse] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
