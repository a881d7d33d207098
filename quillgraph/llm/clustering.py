"""Centroid clustering (Lloyd's rounds) in exact integers, with squared distances from matrix products.

|x - c|^2 = |x|^2 - 2 x.c + |c|^2 is worked out block by block in float64 BLAS while d (max|x| + max|c|)^2
is below 2^53, so that every number on the way is an exact integer; beyond it in 64-bit integers, and beyond
those in Python's. Sums and counts of the clusters are combined by RDD.treeAggregate, in 64 bits or, where
they might overflow, in Python's integers: clusters and distances do not depend on how the rows are dealt.

Vectors are made integers and packed in blocks once; each round reads the blocks from the shared
folder, so a lost executor costs its blocks of one round. The driver holds k centroids, never vectors.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left
out. A null id is a row like any other and is hashed as the text 'null'; repeated rows are rows of their own, and
of equal hashes the smaller vector comes first. Of fewer vectors than k, each is a centroid. A tie goes to
the smaller centroid; an empty cluster keeps its centroid. A distance or sum over 64 bits is given as
the largest long, while the rounds go on with the exact one. An empty table gives an empty result.
Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import vectorblocks as B
from .common import materialize

K, ROUNDS, DIMS, FACTOR, SEED = 40, 5, 64, 256, 2
_SAFE = 2**62


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c, exactly."""
    bound = x.shape[1] * (B.largest(x) + B.largest(c)) ** 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    x, c = x.astype(kind), c.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return out.astype(np.int64) if kind is np.float64 else out


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row; ties go to the smaller number."""
    d = distances(x, c)
    near = np.argmin(d, axis=1)
    return near, d[np.arange(len(x)), near]


def plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    """Sum of integers; in Python's where 64 bits might not do."""
    if a is None or b is None:
        return b if a is None else a
    if a.dtype == object or b.dtype == object or max(B.largest(a), B.largest(b)) >= _SAFE:
        return a.astype(object) + b.astype(object)
    return a + b


def _sums(near: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Column sums of the values by cluster, and the rows of each in the last column."""
    if values.dtype != object and B.largest(values) * len(values) >= _SAFE:
        values = values.astype(object)
    counted = np.concatenate([values, np.ones((len(values), 1), values.dtype)], axis=1)
    out = np.zeros((k, counted.shape[1]), counted.dtype)
    order = np.argsort(near, kind="stable")
    own, first = np.unique(near[order], return_index=True)
    out[own] = np.add.reduceat(counted[order], first, axis=0)
    return out


def _matrix(row: Row) -> np.ndarray:
    return B.matrix(row.d, row.wide, len(row.ids), row.x)


def _tree(blocks: DataFrame, c: np.ndarray, values) -> np.ndarray | None:
    """Sums by cluster of values(x, distance) over all blocks."""

    def add(total: np.ndarray | None, row: Row) -> np.ndarray:
        x = _matrix(row)
        near, far = assign(x, c)
        return plus(total, _sums(near, values(x, far), len(c)))

    return blocks.select("d", "wide", "ids", "x").rdd.treeAggregate(None, add, plus)


def moved(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The centroids after a round; total: sums, and counts in the last column."""
    out = c.astype(object)
    full = total[:, -1] > 0
    out[full] = total[full, :-1].astype(object) // total[full, -1:].astype(object)
    return out if B.largest(out) >= 2**31 else out.astype(np.int64)


@dataclass
class Clustering:
    """The centroids (numbered), the rows of each cluster, its inertia, and the blocks that were clustered."""

    blocks: DataFrame
    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int]

    def assigned(self) -> DataFrame:
        """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
        c = self.centroids
        sha = np.array([hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c], object)
        own, total = np.array([min(i, B.LARGEST) for i in self.inertias], np.int64), min(sum(self.inertias), B.LARGEST)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    x = B.matrix(row["d"], row["wide"], len(row["ids"]), row["x"])
                    near, far = assign(x, c)
                    yield pa.record_batch(
                        [pa.array(row["ids"], pa.int64()), pa.array(near.astype(np.int32)), pa.array(B.as_long(far)), pa.array(own[near]), pa.array(np.full(len(near), total, np.int64)), pa.array(sha[near], pa.string())],
                        ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                    )

        return self.blocks.select("d", "wide", "ids", "x").mapInArrow(apply, "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def first_centroids(rows: DataFrame, k: int, dims: int, factor: int, seed: int) -> np.ndarray:
    """The k vectors whose id has the smallest hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k)  # k rows, held in memory
    found = [[B._wide_floor(x, factor) for x in r["vector"]] for r in first.collect()]
    out = np.array(found, object).reshape(len(found), dims)
    return out if B.largest(out) >= 2**31 else out.astype(np.int64)


def cluster(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, factor: int = FACTOR, seed: int = SEED) -> Clustering:
    """The vectors of df that have `dims` components, times factor and rounded down, in k clusters after the given rounds."""
    rows = B.kept(df, ident, vector).where(F.size("vector") == dims)
    blocks = materialize(B.pack(B.integers(rows, factor)))
    c = first_centroids(rows, k, dims, factor, seed)
    if not len(c):
        return Clustering(blocks, c, [], [])
    for _ in range(rounds):
        c = moved(c, _tree(blocks, c, lambda x, far: x))
    total = _tree(blocks, c, lambda x, far: far[:, None])
    return Clustering(blocks, c, [int(n) for n in total[:, 1]], [int(i) for i in total[:, 0]])


def _round_sql(r: int) -> str:
    """One round: near{r} assigns to cent{r}, cent{r+1} is what that makes of it."""
    return f"""near{r} AS MATERIALIZED (SELECT r, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
  SELECT r, v, c, (vv - 2 * list_dot_product(v, m) + list_dot_product(m, m))::BIGINT AS d FROM kept, cent{r}) GROUP BY r),
sums{r} AS (SELECT c, list(floor_ ORDER BY j) AS m FROM (SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS floor_
  FROM (SELECT best.c AS c, unnest(v)::HUGEINT AS x, unnest(range(len(v))) AS j FROM near{r}) GROUP BY c, j) GROUP BY c),
cent{r + 1} AS MATERIALIZED (SELECT c, coalesce(s.m, p.m) AS m FROM cent{r} p LEFT JOIN sums{r} s USING (c))"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v, list_dot_product(v, v) AS vv FROM (
  SELECT vec_id, list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})),
cent0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c, v AS m FROM kept QUALIFY c < {K}),
{",".join(_round_sql(r) for r in range(ROUNDS))},
final AS (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, (vv - 2 * list_dot_product(v, m) + list_dot_product(m, m))::BIGINT AS d FROM kept, cent{ROUNDS}) GROUP BY r),
per AS (SELECT best.c AS c, sum(best.d)::BIGINT AS i FROM final GROUP BY 1)
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, per.i AS cluster_inertia, (SELECT sum(i)::BIGINT FROM per) AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM final JOIN kept USING (r) JOIN per ON per.c = best.c JOIN cent{ROUNDS} ce ON ce.c = best.c
"""
