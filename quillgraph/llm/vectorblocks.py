"""Vectors as integers, packed in blocks: what the search and the clustering of vectors work on.

A component x becomes floor(factor * x), exactly. Components of 32 bits are stored as such; a vector
with larger ones is `wide` and is kept as decimal text, so that its arithmetic stays exact in Python's
integers. Vectors that are null or hold null or non-finite components take no part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a block (one row at least).
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 20
_NARROW = 2**31
LARGEST = 2**63 - 1

ROWS = "d int, wide boolean, id long, norm double, x binary"
BLOCKS = "part int, seq int, d int, wide boolean, ids array<long>, norms binary, top double, x binary"


def kept(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, vector (array of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(ident).cast("long").alias("id"), v.alias("vector")).where(F.col("vector").isNotNull() & finite)


def _wide_floor(x: float, factor: int) -> int:
    return math.floor(x * factor) if math.isfinite(x * factor) else int(x) * factor


def integers(rows: DataFrame, factor: int) -> DataFrame:
    """ROWS of kept() vectors; norm is an upper bound of the length of the integer vector. factor: a power of two."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            size = np.diff(np.asarray(vectors.offsets))
            flat, start = np.asarray(vectors.flatten(), np.float64), np.cumsum(size) - size
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                step = max(1, (8 << 20) // (8 * max(1, d)))
                for a in range(0, len(at), step):
                    own = at[a : a + step]
                    raw = flat[start[own][:, None] + np.arange(d)]
                    with np.errstate(over="ignore"):
                        x = np.floor(raw * factor)
                    wide = (np.abs(x) >= _NARROW).any(axis=1)
                    x[wide] = 0
                    norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)
                    data = [r.tobytes() for r in x.astype("<i4")]
                    for k in np.flatnonzero(wide).tolist():
                        whole = [_wide_floor(v, factor) for v in raw[k].tolist()]
                        data[k] = json.dumps(whole).encode()
                        norm[k] = float(min(math.isqrt(sum(v * v for v in whole)) + 1, 10**300)) * (1 + 1e-9)
                    yield pa.record_batch([pa.array(np.full(len(own), d, np.int32)), pa.array(wide), ids.take(pa.array(own)), pa.array(norm), pa.array(data, pa.binary())], ["d", "wide", "id", "norm", "x"])

    return rows.mapInArrow(apply, ROWS)


def pack(rows: DataFrame) -> DataFrame:
    """BLOCKS of ROWS, in the order in which they come; a block has vectors of one dimension and kind."""
    from pyspark import TaskContext

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seq = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        key, held = None, ([], [], [])

        def block() -> pa.RecordBatch:
            nonlocal held, seq
            ids, norms, x = held
            body = b"".join(x) if not key[1] else b"[" + b",".join(x) + b"]"
            out = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(norms).tobytes()], pa.binary()), pa.array([max(norms)]), pa.array([body], pa.binary())],
                ["part", "seq", "d", "wide", "ids", "norms", "top", "x"],
            )
            held, seq = ([], [], []), seq + 1
            return out

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for d, wide, ident, norm, x in zip(*columns):
                if held[0] and (key != (d, wide) or len(held[0]) >= max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, d))))):
                    yield block()
                key = (d, wide)
                for to, v in zip(held, (ident, norm, x)):
                    to.append(v)
        if held[0]:
            yield block()

    return rows.mapInArrow(apply, BLOCKS)


def matrix(d: int, wide: bool, n: int, x: bytes) -> np.ndarray:
    """The vectors of a block: 64-bit integers, or Python's where it is wide."""
    if not wide:
        return np.frombuffer(x, "<i4").reshape(n, d).astype(np.int64)
    out = np.empty((n, d), object)
    out[:] = json.loads(bytes(x))
    return out


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and of b: in doubles where every partial sum is below 2^53, else in 64 bits, else in Python's integers."""
    bound = a.shape[1] * largest(a) * largest(b)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def as_long(x: np.ndarray) -> np.ndarray:
    """Numbers beyond 64 bits count as the largest or smallest long."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([min(max(int(v), -LARGEST - 1), LARGEST) for v in x.ravel()], np.int64).reshape(x.shape)
