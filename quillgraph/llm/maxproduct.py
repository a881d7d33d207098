"""Exact top-k search by inner product: vectors in order of length, partial sums along the principal axes, and pruning.

Components become integers (floor of factor * x), so scores are exact. Candidates are sorted by length
over the whole cluster and packed in blocks; blocks make columns, which are sorted by their longest vector.
Queries are packed in blocks too, and go through three sieves, none of which loses a result:

1. The longest candidates of their dimension give each query a score that ten candidates reach. A column whose
   longest vector times the query's length stays below it is not sent to that query's block at all.
2. Within a block of candidates the same bound leaves out single queries.
3. All vectors are rotated by the singular vectors of the candidates. After each quarter of the
   axes, the product so far plus the product of the lengths of what is left (Cauchy-Schwarz) bounds the
   score from above; what stays below the query's bar goes out. What survives is scored exactly in integers.

Blocks of queries meet columns by a join on (dimension, column, band), a band being some 16 blocks of queries:
a grid of which each task has a part, so nothing grows with the table in one task, one group or the driver
but a number for each column. A join has k results for each query and pair of blocks at most, and the best k of those are
taken by a ranking that drops the rest before its shuffle. It is quadratic work by nature: a stated set of
queries against all rows; the sieves lower it as far as the lengths and the spectrum of the data allow.

Defined cases: vectors that are null or hold null or non-finite components, and those of a null id, take no part. Vectors of
different length are no candidates for each other. A query's own rows are all rows of its id; other repeated
rows count one by one. Scores beyond 64 bits count as the largest or smallest long. Ties go to the smaller id. With
fewer than k candidates all are given, and without any, none. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import vectorblocks as B
from .common import batches_of, materialize

K, FACTOR, EVERY = 10, 1024, 100
#: Blocks of candidates in a column and blocks of queries in a band.
COLUMN_BLOCKS, BAND_BLOCKS = 64, 16
#: Dimensions (the most common ones) that are rotated and have a first bar: a block and a rotation of each go to every task,
#: (1 + 2) MB at most. Vectors of other dimensions are compared without: the same results, more work.
SERVED, ROTATED = 16, 512
#: Products that are held at once.
_STEP = 1 << 20
_SLACK = 1e-9


def sorted_blocks(rows: DataFrame) -> DataFrame:
    """BLOCKS of the rows in order of dimension and length, longest first, over all tasks; column numbers them in runs."""
    order = [F.asc("d"), F.desc("norm"), F.asc("id"), F.asc("x")]
    blocks = B.pack(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return blocks.withColumn("column", F.col("part").cast("long") * F.lit(1 << 32) + F.floor(F.col("seq") / F.lit(COLUMN_BLOCKS)))


def rotations(blocks: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """The right singular vectors of all narrow vectors of each dimension, largest singular value first."""
    wanted = [d for d in dims if 0 < d <= ROTATED]

    def add(total: dict | None, row: Row) -> dict:
        x = B.matrix(row.d, row.wide, len(row.ids), row.x).astype(np.float64)
        return both(total, {row.d: x.T @ x})

    def both(a: dict | None, b: dict | None) -> dict | None:
        if not a or not b:
            return a or b
        return {d: (a[d] + b[d]) if d in a and d in b else a.get(d, b.get(d)) for d in {*a, *b}}

    found = blocks.where(~F.col("wide") & F.col("d").isin(wanted)).select("d", "wide", "ids", "x").rdd.treeAggregate(None, add, both)
    return {d: np.linalg.eigh(gram)[1][:, ::-1].copy() for d, gram in (found or {}).items()}


class Side:
    """A block's ids, integers, lengths and rotated coordinates."""

    def __init__(self, row: dict, rotation: np.ndarray | None):
        self.ids = np.array(row["ids"], np.int64)
        self.x = B.matrix(row["d"], row["wide"], len(self.ids), row["x"])
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.top = row["top"]
        self.turned = None if row["wide"] or rotation is None else self.x.astype(np.float64) @ rotation

    def rest(self, a: int) -> np.ndarray:
        """Lengths of the vectors along the axes from a on, from above."""
        return np.sqrt((self.turned[:, a:] ** 2).sum(axis=1)) + _SLACK * self.norms


def hopeful(q: Side, rows: np.ndarray, c: Side, bar: np.ndarray) -> np.ndarray:
    """Whether the product of each of the rows of q with each of c may reach the row's bar."""
    alive = q.norms[rows][:, None] * c.norms[None, :] * (1 + _SLACK) >= bar[rows][:, None]
    if q.turned is None or c.turned is None:
        return alive
    d = q.turned.shape[1]
    ends = sorted({d // 4, d // 2, 3 * d // 4} - {0})
    so_far, start = np.zeros(alive.shape), 0
    slack = 1e-6 * (1 + q.norms[rows][:, None] * c.top * 1e-6)
    for end in ends:
        if not alive.any():
            break
        so_far += q.turned[rows, start:end] @ c.turned[:, start:end].T
        alive &= so_far + q.rest(end)[rows][:, None] * c.rest(end)[None, :] + slack >= bar[rows][:, None]
        start = end
    return alive


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score.astype(np.float64) if score.dtype == object else ~score, q))  # ~s falls as s rises, without overflow
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], ids[place < k], score[place < k]


def meet(q: Side, c: Side, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score): the k best of c for each row of q among those that may reach its bar."""
    step = max(1, _STEP // max(1, len(c.ids)))
    todo = np.flatnonzero(q.norms * c.top * (1 + _SLACK) >= bar)
    out = []
    for a in range(0, len(todo), step):
        rows = todo[a : a + step]
        alive = hopeful(q, rows, c, bar) & (q.ids[rows][:, None] != c.ids[None, :])
        near, far = np.nonzero(alive)
        if not len(near):
            continue
        if len(near) * 20 >= alive.size:
            score = B.as_long(B.products(q.x[rows], c.x))[near, far]
        else:
            score = np.concatenate([_pairwise(q.x[rows[near[b : b + _STEP // 16]]], c.x[far[b : b + _STEP // 16]]) for b in range(0, len(near), _STEP // 16)])
        out.append(_best(rows[near], c.ids[far], score, k))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of row i of a with row i of b."""
    if a.shape[1] * B.largest(a) * B.largest(b) >= 2**63:
        a, b = a.astype(object), b.astype(object)
    return B.as_long((a * b).sum(axis=1))


def raised(bar: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The bar, raised to the k-th of a row's k best scores (from meet()), rounded down."""
    out = bar.copy()
    n = np.bincount(rows, minlength=len(bar))
    least = np.full(len(bar), B.LARGEST, np.int64)
    np.minimum.at(least, rows, score)
    full = n >= k
    out[full] = np.maximum(out[full], np.nextafter(least[full].astype(np.float64), -np.inf))
    return out


def _first_blocks(blocks: DataFrame) -> dict[int, dict]:
    """The block of the longest candidates of each of the most common dimensions."""
    common = blocks.groupBy("d").agg(F.sum(F.size("ids")).alias("n"), F.max("top").alias("top")).orderBy(F.desc("n"), "d").limit(SERVED).collect()
    out = {}
    for r in common:
        found = blocks.where((F.col("d") == r["d"]) & (F.col("top") >= r["top"])).orderBy("part", "seq").limit(1).collect()
        out |= {b["d"]: b.asDict() for b in found}  # one block, at most B.BLOCK_BYTES and its ids
    return out


def with_bars(queries: DataFrame, first: dict[int, dict], turn: dict[int, np.ndarray], columns: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Blocks of queries with the bar of each and the columns that may have something for it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {d: Side(b, turn.get(d)) for d, b in first.items()}
        for t in batches:
            for n, row in enumerate(t.to_pylist()):
                q, bar = Side(row, turn.get(row["d"])), np.full(len(row["ids"]), -np.inf)
                if row["d"] in sides:
                    rows, _, score = meet(q, sides[row["d"]], bar, k)
                    bar = raised(bar, rows, score, k)
                names, tops = columns.get(row["d"], (np.empty(0, np.int64), np.empty(0)))
                wanted = [int(c) for c, top in zip(names, tops) if (q.norms * top * (1 + _SLACK) >= bar).any()]
                yield pa.RecordBatch.from_arrays([*t.slice(n, 1).columns, pa.array([bar.tobytes()], pa.binary()), pa.array([wanted], pa.list_(pa.int64()))], names=[*t.schema.names, "bar", "wanted"])

    return queries.mapInArrow(apply, B.BLOCKS + ", bar binary, wanted array<long>")


def search(df: DataFrame, queries: Column, ident: str = "vec_id", vector: str = "embedding", k: int = K, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row of df for which `queries` (of column id) holds."""
    spark = df.sparkSession
    rows = materialize(B.integers(B.kept(df, ident, vector).where("id is not null"), factor))
    with batches_of(spark, 2):  # blocks are rows of a MB and more
        blocks = materialize(sorted_blocks(rows))
        asked = materialize(sorted_blocks(rows.where(queries)).drop("column"))
        first = _first_blocks(blocks)
        turn = rotations(blocks, list(first))
        tops: dict[int, list] = {}
        for r in blocks.groupBy("d", "column").agg(F.max("top").alias("top")).collect():  # a number for each column
            tops.setdefault(r["d"], []).append((r["column"], r["top"]))
        columns = {d: tuple(map(np.array, zip(*sorted(c, key=lambda x: -x[1])))) for d, c in tops.items()}
        asked = materialize(with_bars(asked, first, turn, columns, k))
        bands = max(1, -(-asked.count() // BAND_BLOCKS))
        left = asked.select("d", F.pmod(F.xxhash64("part", "seq"), F.lit(bands)).alias("band"), F.explode("wanted").alias("column"), F.struct("part", "seq", "d", "wide", "ids", "norms", "top", "x", "bar").alias("q"))
        right = blocks.select("d", "column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))).alias("band"), F.struct("d", "wide", "ids", "norms", "top", "x").alias("c"))
        pairs = left.join(right, ["d", "column", "band"]).select("q", "c")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bars: dict[tuple[int, int], np.ndarray] = {}  # of the blocks that this task has met
            for t in batches:
                for row in t.to_pylist():
                    a, b = row["q"], row["c"]
                    q, c, at = Side(a, turn.get(a["d"])), Side(b, turn.get(b["d"])), (a["part"], a["seq"])
                    bar = bars.get(at, np.frombuffer(a["bar"], np.float64))
                    found, ids, score = meet(q, c, bar, k)
                    bars[at] = raised(bar, found, score, k)
                    yield pa.record_batch([pa.array(np.full(len(found), (at[0] << 32) + at[1], np.int64)), pa.array(found), pa.array(q.ids[found]), pa.array(ids), pa.array(score)], ["block", "row", "query_id", "vec_id", "score"])

        found = materialize(pairs.mapInArrow(apply, "block long, row long, query_id long, vec_id long, score long"))
    best = Window.partitionBy("block", "row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM kept q JOIN kept c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= {K}
"""
