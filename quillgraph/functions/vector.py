"""Vector expressions and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for null, empty, unequal lengths or a zero norm."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(_sum(F.transform(b, lambda x: x.cast("double") * x)))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(ok, dot / norm).otherwise(F.lit(0.0))


def mock_embedding(text: Column, dims: int = 1536) -> Column:
    """sin(i + sum of the bytes mod 65536) / 10 for i < dims: the deterministic offline embedder. Null for blank text."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    total = F.aggregate(F.sequence(F.lit(1), F.octet_length(text)), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.substr(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    out = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.sin((i + F.pmod(total, F.lit(65536))).cast("double")) * 0.1)
    return F.when(F.trim(text) != "", out)


def ngram_embedding(text: Column, n: int = 3, dims: int = 256) -> Column:
    """How often each of `dims` buckets has an n-gram of the text (lower case, with a space on either side): names that look alike are near. Null for blank text.

    The bucket of an n-gram is its MD5's first eight hex digits, modulo dims.
    """
    t = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    bucket = lambda i: F.conv(F.substring(F.md5(F.substr(t, i, F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("long") % dims
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), bucket)
    # As the one element of an array the n-grams are made once, and not again for each bucket.
    counted = F.transform(F.array(grams), lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.size(F.filter(own, lambda g: g == b)).cast("double")))
    return F.when(F.trim(text) != "", counted[0])


def ngram_bytes(text: Column, n: int = 3) -> Column:
    """The buckets of ngram_embedding() with its 256 dims, a byte for each n-gram: some twenty bytes for a name, and not two thousand."""
    t = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    last = lambda i: F.substring(F.md5(F.substr(t, i, F.lit(n)).cast("binary")), 7, 2)
    return F.when(F.trim(text) != "", F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), last), "")))


def top_k(items: DataFrame, vector: str, query: list[float], k: int, *, least: float | None = None, ident: str = "id") -> DataFrame:
    """items with similarity and distance to one query, the k nearest; ties by id. Plans as TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = items.where(F.col(vector).isNotNull()).withColumn("similarity", cosine(F.col(vector), q)).withColumn("distance", 1 - F.col("similarity"))
    if least is not None:
        out = out.where(F.col("similarity") >= least)
    return out.orderBy("distance", ident).limit(k)


#: Bytes of vectors (as doubles) of one side of a tile.
TILE_BYTES = 16 << 20
#: Tiles of a query whose results are merged at once.
FAN = 64
#: Scores that a task works out at once.
_SCORES = 4 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Best:
    """The k best items of each query, of what a task has seen; ties by id, and an item that is seen twice counts once."""

    def __init__(self, k: int):
        self.k, self.q, self.i, self.s = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        """Scores of queries (rows) and items (columns); -inf is none."""
        if s.shape[1] > self.k:  # more than k of a row need not be kept; ties with the last of them are
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        else:
            row, col = np.nonzero(np.isfinite(s))
        self.take(q[row], i[col], s[row, col])

    def take(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        """Scores of pairs of a query and an item."""
        self.new.append((q, i, s))
        self.waiting += len(q)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, s = (np.concatenate(x) for x in zip((self.q, self.i, self.s), *self.new))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        if len(q):
            once = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
            q, i, s = q[once], i[once], s[once]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            q, i, s = (x[place < self.k] for x in (q, i, s))
        self.q, self.i, self.s, self.new, self.waiting = q, i, s, [], 0
        return q, i, s


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a table of rows of one length, of length 1 each."""
    flat = t["vector"].combine_chunks().flatten()
    return _unit(np.asarray(flat, np.float64).reshape(t.num_rows, -1))


def _scores(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, least: float, drop_self: bool) -> np.ndarray:
    # Equal vectors have equal scores wherever they stand, so that ties go by id.
    s = np.round(q @ x.T, 12)
    if drop_self:
        s[q_ids[:, None] == ids[None, :]] = -np.inf
    s[~(s >= least)] = -np.inf
    return s


def usable(df: DataFrame, key: Column) -> DataFrame:
    """id, vector (doubles), key and d of the rows whose vector is there, has components, and all of them are finite."""
    v = F.col("vector").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("id", v.alias("vector"), key.alias("key"), F.size("vector").alias("d")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.col("d") > 0) & finite)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity, rank of the k best of each query; part: where results come from, merged FAN at a time first."""
    order = [F.desc("similarity"), F.asc("id")]
    if "part" in found.columns:
        some = Window.partitionBy("query_id", F.floor(F.col("part") / FAN)).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    found = found.select("query_id", "id", "similarity").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _once(t: pa.Table, payload: str) -> pa.Table:
    """Without rows that repeat an id and its vector: they count once."""
    ids = t["id"].to_numpy()
    if len(np.unique(ids)) == len(ids):
        return t
    seen: dict[tuple, int] = {}
    for n, row in enumerate(zip(ids.tolist(), t[payload].to_pylist())):
        seen.setdefault((row[0], row[1] if isinstance(row[1], bytes) else tuple(row[1])), n)
    return t.take(pa.array(sorted(seen.values())))


def _tiles(q: DataFrame, x: DataFrame, payload: str, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, packed: bool = False) -> DataFrame:
    """What meet() makes of each part of q (usable()) and each part of x (id, payload, key, d) of the same key and d.

    Parts have some TILE_BYTES of vectors; how many there are of a key is counted within the job. Packed: see _packed_tiles().
    """
    if packed:
        return _packed_tiles(q, x, meet, schema)
    rows = F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("d"))))
    parts = lambda df, name: df.groupBy("key", "d").agg(F.count(F.lit(1)).alias("n")).select("key", "d", F.ceil(F.col("n") / rows).cast("int").alias(name))
    sizes = parts(q, "pq").join(parts(x, "px"), ["key", "d"])  # a row for each label
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    tile = ["key", "d", "at", "part"]
    # Columns are named anew on both sides, which may come from one table.
    left = q.join(sizes, ["key", "d"]).select("id", "vector", "key", "d", own("pq").alias("at"), all_of("px").alias("part")).toDF("id", "vector", *tile)
    right = x.join(sizes, ["key", "d"]).select("id", payload, "key", "d", all_of("pq").alias("at"), own("px").alias("part")).toDF("id", payload, *tile)
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(meet, schema)


_FOUND = "query_id long, id long, similarity double, part int"


def _found(best: _Best, items: pa.Table) -> pa.Table:
    q, ident, score = best.settle()
    part = items["part"][0].as_py() if items.num_rows else 0
    return pa.table([pa.array(q), pa.array(ident), pa.array(score.astype(np.float64)), pa.array(np.full(len(q), part, np.int32))], ["query_id", "id", "similarity", "part"])


def nearest(queries: DataFrame, items: DataFrame, k: int, *, least: float = -1.0, same_label: bool = False, drop_self: bool = True) -> DataFrame:
    """query_id, id, similarity, rank: exact k nearest of every query among all items; ties by id.

    queries and items have id (long), vector and (for same_label) label, of any type. Null and empty
    vectors and those with null or non-finite components take no part, nor does a null label, and vectors of unequal length
    are no candidates for each other. Both sides are cut by label and length into parts of some TILE_BYTES, and each part of
    the queries meets each part of the items of its label in a task of its own, which keeps the k best; a label of a third of all rows
    is many tiles. No vector goes through the driver, and it is one job.
    """
    key = (lambda: F.col("label")) if same_label else (lambda: F.lit(0))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        best, b = _Best(k), _once(b, "vector")
        if a.num_rows and b.num_rows:
            q_ids, ids, qv, xv = a["id"].to_numpy(), b["id"].to_numpy(), _matrix(a), _matrix(b)
            step = max(1, _SCORES // len(ids))
            for n in range(0, len(q_ids), step):
                best.add(q_ids[n : n + step], ids, _scores(qv[n : n + step], xv, q_ids[n : n + step], ids, least, drop_self))
        return _found(best, b)

    return ranked(_tiles(usable(queries, key()), usable(items, key()), "vector", meet, _FOUND), k)


def _coded(df: DataFrame) -> DataFrame:
    """id, vector, key, d of usable() vectors, made to unit length, as a byte for each component, and behind these two single floats: what a byte stands for and how far off all are, at most.

    The key has the length, and d half of it: single floats take that many bytes of doubles.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(3).to_numpy()
            for d in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == d))
                x = _matrix(pa.Table.from_batches([own]))
                unit = (np.abs(x).max(axis=1) / 127).astype(np.float32)
                code = np.rint(x / np.maximum(unit, np.float32(1e-30))[:, None].astype(np.float64))
                off = (np.linalg.norm(x - code * unit[:, None], axis=1) + 1e-7).astype(np.float32)
                sent = np.concatenate([code.astype(np.int8).view(np.uint8), np.stack([unit, off], axis=1).view(np.uint8)], axis=1)
                yield pa.record_batch([own.column(0), pa.array([r.tobytes() for r in sent], pa.binary()), own.column(2), own.column(3)], ["id", "vector", "key", "d"])

    coded = df.select("id", "vector", F.col("key").cast("string").alias("key"), "d").mapInArrow(apply, "id long, vector binary, key string, d int")
    return coded.select("id", "vector", F.concat("key", F.lit(":"), "d").alias("key"), F.ceil(F.col("d") / 2).cast("int").alias("d"))


def nearest_coded(queries: DataFrame, items: DataFrame, k: int, *, least: float) -> DataFrame:
    """query_id, id, similarity, rank: as nearest() within labels, self included, of those of a similarity of `least`; ids are not repeated on either side.

    Tiles are of bytes and leave out what surely is not among the best; vectors themselves go to the pairs that remain, once for each.
    """
    q, x = (cut(usable(df, F.col("label")).where("key is not null")) for df in (queries, items))

    def decoded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.float32]:
        rows = np.frombuffer(b"".join(t["vector"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        ends = np.ascontiguousarray(rows[:, -8:]).view(np.float32)
        return rows[:, :-8].view(np.int8).astype(np.float32), ends[:, 0], ends[:, 1].max()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        if a.num_rows and b.num_rows:
            q_ids, ids, (qc, qu, q_off), (xc, xu, x_off) = a["id"].to_numpy(), b["id"].to_numpy(), decoded(a), decoded(b)
            off = float(q_off + (1 + q_off) * x_off) + 1e-6 + 2e-7 * qc.shape[1]  # the last is of sums in single precision
            step = max(1, _SCORES // len(ids))
            for n in range(0, len(q_ids), step):
                s = (qc[n : n + step] * qu[n : n + step, None]) @ xc.T * xu
                bar = np.full(len(s), least - off, np.float64)
                many = np.flatnonzero((s >= least - off).sum(1) > k)
                if len(many):
                    bar[many] = np.maximum(bar[many], np.partition(s[many], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * off)
                row, col = np.nonzero(s >= bar[:, None])
                near = s[row, col].astype(np.float64)
                out.append((q_ids[n + row], ids[col], near - off, near + off))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "low", "high"])

    met = _tiles(_coded(q), _coded(x), "vector", meet, "query_id long, id long, low double, high double")
    whole = Window.partitionBy("query_id").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    few = cut(met.withColumn("bar", F.nth_value("low", k).over(whole)).where("bar is null or high >= bar").select("query_id", "id"))
    pairs = few.join(q.select(F.col("id").alias("query_id"), F.col("vector").alias("a")), "query_id").join(x.select("id", F.col("vector").alias("b")), "id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(2).value_lengths())
            for d in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == d))
                one, two = (_unit(np.asarray(own.column(c).flatten(), np.float64).reshape(own.num_rows, -1)) for c in (2, 3))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(np.round((one * two).sum(axis=1), 12))], ["query_id", "id", "similarity"])

    scored = pairs.select("query_id", "id", "a", "b").mapInArrow(exact, "query_id long, id long, similarity double")
    return ranked(scored.where(F.col("similarity") >= least), k)


#: What a cosine in single precision may be off by, at most.
_OFF = 2e-5
#: Counts of n-grams that are made at once; names that have one bound together, and asked ones that are held against these bounds at once.
_COUNTED, _TOGETHER, _ASKED = 1 << 19, 16, 2048
#: Tasks at most that tiles of names are dealt to.
_NAME_TASKS = 1024


def _counts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How often each row has each of 256 values, and the squares of the lengths of these vectors."""
    size = np.array([len(r) for r in rows], np.int64)
    n = np.empty((len(rows), 256), np.float32)
    ends = np.flatnonzero(np.diff(np.cumsum(size + 256) // _COUNTED)) + 1  # a step's bytes and counts are bounded, but for a row that is longer
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(rows)]):
        at = np.repeat(np.arange(b - a) * 256, size[a:b]) + np.frombuffer(b"".join(rows[a:b]), np.uint8)
        n[a:b] = np.bincount(at, minlength=256 * (b - a)).reshape(-1, 256)
    return n, np.einsum("ij,ij->i", n, n, dtype=np.float64)


def _packed_tiles(q: DataFrame, x: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What meet() makes of each part of q and each part of x (id and vector of both), of half of TILE_BYTES of counts and of four times TILE_BYTES; both are written out, so that counting them is cheap.

    A part is packed to one row before it is sent to the parts of the other side: names are short, and the JVM need not hold, sort and send each of them for every tile.
    """
    pq, px = (max(1, -(-df.count() * size // TILE_BYTES)) for df, size in ((q, 2048), (x, 256)))

    def pack(t: pa.Table) -> pa.Table:
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, (own := t.select(["id", "vector"])).schema) as to:
                to.write_table(own)
            return pa.table({"own": t["own"][:1], "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    def unpacked(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t
        own = pa.ipc.open_stream(t["rows"][0].as_buffer()).read_all()
        return own.append_column("part", pa.array(np.full(own.num_rows, t["part"][0].as_py(), np.int32)))

    parts = lambda df, n: df.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own")).groupBy("own").applyInArrow(pack, "own int, rows binary")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df: df.repartition(min(pq * px, _NAME_TASKS), "at", "part").groupBy("at", "part")  # noqa: E731, few bytes are much work: AQE joins no tasks
    left = dealt(parts(q, pq).select(F.col("own").alias("at"), all_of(px).alias("part"), "rows"))
    right = dealt(parts(x, px).select(all_of(pq).alias("at"), F.col("own").alias("part"), "rows"))
    return left.cogroup(right).applyInArrow(lambda a, b: meet(unpacked(a), unpacked(b)), schema)


def nearest_names(queries: DataFrame, items: DataFrame, k: int, *, least: float = 0.0) -> DataFrame:
    """query_id, id, similarity, rank: exact k nearest by ngram_embedding() of every query's name among all items' (id, name both); ties by id.

    Null and blank names take no part, and an item's id has one name. Equal names, ignoring case and outer space, are compared once: of an item's name its k
    smallest ids can be among the k nearest, and so can the k nearest names only, ordered by their smallest ids. Names travel as a byte for each n-gram, part
    meets part. In a part names that begin alike stand together, and some tens of them are left out at once where the largest share of each n-gram that any of them has
    is not enough to be among the best; cosines in single precision leave out what is surely not among the best before the exact ones.
    """
    named = lambda df: df.select("id", F.lower(F.trim("name")).alias("name")).where("id is not null and name <> ''")
    asked = named(queries)
    first = named(items).withColumn("r", F.dense_rank().over(Window.partitionBy("name").orderBy("id"))).where(F.col("r") <= k)
    copies = first.groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # k at most
    # Each side's names are embedded once, and an item's name is not needed any more.
    q = cut(asked.groupBy("name").agg(F.min("id").alias("id")).select("id", "name", ngram_bytes(F.col("name")).alias("vector")))
    x = cut(copies.select(F.col("ids")[0].alias("id"), "ids", ngram_bytes(F.col("name")).alias("vector")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        best = _Best(k)
        if a.num_rows and b.num_rows:
            q_ids, (qc, qn), rows = a["id"].to_numpy(), _counts(a["vector"].to_pylist()), b["vector"].to_pylist()
            order = sorted(range(len(rows)), key=rows.__getitem__)  # names that begin alike stand together
            ids, q_unit, size = b["id"].to_numpy()[order], (1 / np.sqrt(qn)).astype(np.float32), max(1, TILE_BYTES // 1024)
            top = np.full((len(q_ids), k), -np.inf, np.float32)  # the k best so far, the least of them first
            bar = lambda at: (np.maximum(top[at, 0], least) - 2 * _OFF).astype(np.float32)
            for m in range(0, len(ids), size):
                xc, xn = _counts([rows[i] for i in order[m : m + size]])
                x_unit, exactly = (1 / np.sqrt(xn)).astype(np.float32), np.float32 if qn.max() * xn.max() < 2**48 else np.float64  # counts make whole numbers
                most = np.stack([(xc[c : c + _TOGETHER] * x_unit[c : c + _TOGETHER, None]).max(axis=0) for c in range(0, len(xc), _TOGETHER)])
                for n in range(0, len(q_ids), _ASKED):
                    all_ = np.arange(n, min(n + _ASKED, len(q_ids)))
                    bound = (qc[all_] @ most.T) * q_unit[all_, None]
                    for j, c in enumerate(range(0, len(xc), _TOGETHER)):
                        at = all_[bound[:, j] >= bar(all_)]
                        if not len(at):
                            continue
                        dot = qc[at].astype(exactly, copy=False) @ xc[c : c + _TOGETHER].T
                        s = (dot * x_unit[c : c + _TOGETHER] * q_unit[at, None]).astype(np.float32, copy=False)
                        up = s.max(axis=1) > top[at, 0]
                        top[at[up]] = np.partition(np.concatenate([top[at[up]], s[up]], axis=1), s.shape[1], axis=1)[:, s.shape[1] :]
                        row, col = np.nonzero(s >= bar(at)[:, None])
                        exact = np.round(dot[row, col].astype(np.float64) / np.sqrt(qn[at[row]] * xn[c + col]), 12)
                        near = exact >= least
                        best.take(q_ids[at[row[near]]], ids[m + c + col[near]], exact[near])
        return _found(best, b)

    found = ranked(_tiles(q, x, "vector", meet, _FOUND, True), k)
    # From names to ids: first the k best ids of each asked name, then all that ask for it.
    best = found.join(x.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("id"), "similarity")
    names = q.select(F.col("id").alias("query_id"), "name")
    few = ranked(best, k).join(names, "query_id").select("name", "id", "similarity")
    return ranked(asked.select(F.col("id").alias("query_id"), "name").join(few, "name").select("query_id", "id", "similarity"), k)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids (as many as there are rows at most) of the rows of x."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            c[n > 0, j] = np.bincount(own, weights=x[:, j], minlength=len(c))[n > 0] / n[n > 0]
    return c


class Quantiser:
    """Unit vectors of one length as a list (the nearest of some centroids) and a byte for each few dimensions of the residual."""

    #: Dimensions of a byte, and its values.
    WIDTH, VALUES = 4, 256

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 6):
        x = sample.astype(np.float32)
        self.d, self.lists = x.shape[1], _kmeans(x, lists, rounds)
        rest = x - self.lists[self._near(x)]
        self.books = [_kmeans(rest[:, a : a + self.WIDTH], self.VALUES, rounds) for a in range(0, self.d, self.WIDTH)]

    def _near(self, x: np.ndarray) -> np.ndarray:
        return ((self.lists * self.lists).sum(1)[None, :] - 2 * (x @ self.lists.T)).argmin(1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Bytes: two of the list, then one for each book."""
        x = x.astype(np.float32)
        near = self._near(x)
        rest = x - self.lists[near]
        codes = [((b * b).sum(1)[None, :] - 2 * (rest[:, n * self.WIDTH : n * self.WIDTH + b.shape[1]] @ b.T)).argmin(1).astype(np.uint8) for n, b in enumerate(self.books)]
        return np.concatenate([near.astype("<u2").view(np.uint8).reshape(-1, 2), np.stack(codes, axis=1)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        near = np.ascontiguousarray(codes[:, :2]).view("<u2").ravel()
        return self.lists[near] + np.concatenate([b[codes[:, 2 + n]] for n, b in enumerate(self.books)], axis=1)


class IVF:
    """An index of lists and product-quantised residuals: a quarter byte a dimension stands for each vector, and only what looks nearest is read in full.

    Lists and code books are fitted on a bounded sample (SAMPLE rows, SAMPLE_BYTES at most) for each of the SERVED most
    common lengths; every row is encoded. A search compares all codes, keeps `wide` candidates a query (at most a TENTH of the rows) and
    compares those exactly. Rows of other lengths are searched exactly. What nearest() leaves out is left out here too; an empty table finds nothing.
    """

    SAMPLE, SAMPLE_BYTES, SERVED, TENTH = 20_000, 64 << 20, 8, 0.1
    #: Candidates for each wanted result.
    WIDE = 20

    def __init__(self, items: DataFrame, lists: int | None = None):
        rows = cut(usable(items, F.lit(0)))
        self.books: dict[int, Quantiser] = {}
        self.counts = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(self.SERVED).collect()}
        for d, n in self.counts.items():
            most = max(1, min(self.SAMPLE, self.SAMPLE_BYTES // (8 * d)))
            some = rows.where((F.col("d") == d) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * most / n) * (1 << 20))))).select("id", "vector").limit(most).toArrow()
            if some.num_rows:
                self.books[d] = Quantiser(_matrix(some), lists or int(min(1024, max(16, n**0.5))))
        books = items.sparkSession.sparkContext.broadcast(self.books)  # bounded by SERVED lengths, 1,024 lists and 256 values

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                d = t.column(2).to_numpy()
                for n in np.unique(d).tolist():
                    own = pa.Table.from_batches([t.filter(pa.array(d == n))])
                    if n in books.value:
                        code = books.value[n].encode(_matrix(own))
                        yield pa.record_batch([own["id"].combine_chunks(), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(np.full(len(code), n, np.int32))], ["id", "code", "d"])

        self.vectors = rows
        self.codes = cut(rows.select("id", "vector", "d").mapInArrow(encode, "id long, code binary, d int").withColumn("key", F.lit(0)))

    def candidates(self, queries: DataFrame, wide: int) -> DataFrame:
        """query_id, id of the `wide` items of each query whose codes look nearest."""
        books = queries.sparkSession.sparkContext.broadcast(self.books)
        most = {d: max(1, min(wide, int(self.TENTH * n))) for d, n in self.counts.items()}

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            best, b = _Best(wide), _once(b, "code")
            if a.num_rows and b.num_rows:
                book, q_ids, ids = books.value[a["d"][0].as_py()], a["id"].to_numpy(), b["id"].to_numpy()
                best.k = most[book.d]
                x = book.decode(np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(ids), -1))
                q, step = _matrix(a).astype(np.float32), max(1, _SCORES // len(ids))
                for n in range(0, len(q_ids), step):
                    s = q[n : n + step] @ x.T
                    s[q_ids[n : n + step, None] == ids[None, :]] = -np.inf
                    best.add(q_ids[n : n + step], ids, s)
            return _found(best, b)

        asked = usable(queries, F.lit(0))
        found = ranked(_tiles(asked, self.codes, "code", meet, _FOUND), wide)
        limits = F.create_map(*[F.lit(v) for kv in most.items() for v in kv]) if most else F.lit(None).cast("map<int,int>")
        sized = found.join(asked.select(F.col("id").alias("query_id"), "d").distinct(), "query_id")
        return sized.where(F.col("rank") <= limits[F.col("d")]).select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int, wide: int | None = None) -> DataFrame:
        """query_id, id, similarity, rank: the k best of each query among its candidates."""
        pairs = self.candidates(queries, wide or self.WIDE * k)
        q = usable(queries, F.lit(0)).select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.col("d").alias("dq"))
        full = pairs.join(self.vectors.select("id", "vector", "d"), "id").join(q, "query_id").where("d = dq")
        found = full.select("query_id", "id", F.round(cosine(F.col("q"), F.col("vector")), 12).alias("similarity"))
        other = ~F.col("d").isin(list(self.books)) if self.books else F.lit(True)
        rest = self.vectors.where(other).select("id", "vector")
        exact = nearest(queries, rest, k).select("query_id", "id", "similarity")
        return ranked(found.unionByName(exact), k)
