"""Near-duplicate classes by BagMinHash: weighted Jaccard of the multisets of five-word shingles.

Signature: each shingle is the seed of Poisson processes over the weight levels [0,1), [1,2),
[2,4), [4,8), ...; where in its level a point lies is drawn at once, and of a level that a
multiplicity covers in part only the points in that part count (thinned so, every sub-level is a
Poisson process of its own, as if points went down the halves of the level one by one). Points come
in order of time and each falls on one of the signature's components, which keeps its earliest
point; a process ends once its time is past the latest of them. Two components agree with a probability that is the weighted Jaccard similarity.

Candidates share a band of rows; every candidate is verified by the exact overlap of multisets.
Texts with equal multisets are one class from the start and are represented by the smallest id.
A band's bucket of up to SMALL texts is compared pair by pair. In a larger one all are compared with
a hub, the smallest id; the group of a hub is everything that met it in a large bucket, and groups with
one largest component are one group, that component's smallest id being their hub. What is outside that
component is then compared with the whole group, tile against tile: a tile holds about TILE texts of like similarity to the hub, and two tiles whose similarities to it are
further apart than the triangle inequality of Jaccard distance allows for a link never meet. So no
link between candidates is lost to the components, while like texts, however many, cost one comparison
each.

Defined cases: a text of fewer than five words, but not none, is one shingle; texts without words
(null, empty) are each a class of their own; rows of a null id have a null class; repeated rows
of one id with one text get one class, with different texts each row that of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batches_of, buffers, column, materialize, mix, shingles, steps
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold shares no band: (1 - 0.8^4)^24 < 4e-6.
BANDS, ROWS = 24, 4
SMALL = 24
#: Texts of a tile, on average.
TILE = 32
#: Steps of similarity to the hub that tiles are kept apart by.
STEP = 0.05
#: Tiles of a hub that meet in one task, on either side; a larger group is dealt to a grid of tasks.
GRID = 64
_STEP = 4 << 20


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m earliest times; inf in the rows without elements."""
    parts, low, level = [(doc, mix(element), np.ones(len(doc)), np.ones(len(doc)))], 1, 1
    while len(more := np.flatnonzero(count > low)):
        covered = np.minimum(count[more], 2 * low) - low
        key = mix(element[more] + U(level * 0xD1342543DE82EF95 % 2**64))
        parts.append((doc[more], key, np.full(len(more), float(low)), covered.astype(float)))
        low, level = 2 * low, level + 1
    who, key, size, covered = (np.concatenate(x) for x in zip(*parts))
    sig = np.full(n * m, np.inf)
    top = np.full(n, np.inf)
    time, live, drawn = np.zeros(len(who)), np.arange(len(who)), 0
    while len(live):
        g = max(1, min(64, 60_000 // len(live)))
        draw = np.arange(drawn + 1, drawn + g + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        x = mix(key[live][:, None] + draw)
        gap = -np.log(((x >> U(11)).astype(np.float64) + 1) * 2.0**-53) / (m * size[live])[:, None]
        # One running sum whatever g is: the same shingle has bit for bit the same times everywhere.
        at = np.cumsum(np.concatenate([time[live][:, None], gap], 1), axis=1)[:, 1:]
        y = mix(x + U(0x632BE59BD9B4E019))
        component = ((y >> U(32)) * U(m) >> U(32)).astype(np.int64)
        place = (y & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size[live][:, None]
        w = np.broadcast_to(who[live][:, None], at.shape)
        hit = (place < covered[live][:, None]) & (at < top[w])
        np.minimum.at(sig, w[hit] * m + component[hit], at[hit])
        time[live], drawn = at[:, -1], drawn + g
        top = sig.reshape(n, m).max(1)
        live = live[time[live] < top[who[live]]]
    return sig.reshape(n, m)


def fingerprints(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits that tell multisets apart; None for the empty one."""
    out: list[bytes | None] = [None] * n
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        c = count.astype(np.uint64)
        a = np.add.reduceat(mix(element + c * U(0x9E3779B97F4A7C15)), first)
        b = np.add.reduceat(mix(element * U(0xD1342543DE82EF95) ^ c), first)
        raw = np.stack([a, b], 1).tobytes()
        for k, d in enumerate(doc[first].tolist()):
            out[d] = raw[16 * k : 16 * k + 16]
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, fp (of the multiset) and the keys of the bands of every document row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, size=_STEP):
            n = b.num_rows
            d, e, c = shingles(*buffers(column(b, "text")), SHINGLE)
            v = signatures(d, e, c, n).view(np.uint64).reshape(n, BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)) * U(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                h = mix(h * U(0xD1342543DE82EF95) + v[:, :, r])
            full = np.zeros(n, bool)
            full[d] = True
            offs = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offs), pa.array(h[full].view(np.int64).ravel()))
            yield pa.record_batch([column(b, "doc_id"), pa.array(fingerprints(d, e, c, n), pa.binary()), bands], ["doc_id", "fp", "bands"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp binary, bands array<long>")


def similarity(a: tuple, b: tuple, n: int) -> np.ndarray:
    """Weighted Jaccard of n pairs of multisets, each side (pair, element, count)."""
    pair, e, c = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((e, pair))
    pair, e, c = pair[order], e[order], c[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (e[1:] == e[:-1]))
    both = np.bincount(pair[same], np.minimum(c[same], c[same + 1]), n)
    total = np.bincount(pair, c, n)
    return both / np.maximum(total - both, 1)


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b, j of the pairs (a, b) whose similarity is `least` at least."""
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text_b", 1 << 20):
            sides = []
            for x in "ab":  # a hub's text stands in many rows, mostly one after the other
                unique = column(b, f"text_{x}").dictionary_encode()
                d, e, c = shingles(*buffers(unique.dictionary), SHINGLE)
                start = np.searchsorted(d, np.arange(len(unique.dictionary) + 1))
                index = unique.indices.to_numpy()
                size = np.diff(start)[index]
                at = np.repeat(start[index], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                sides.append((np.repeat(np.arange(len(index)), size), e[at], c[at]))
            j = similarity(*sides, b.num_rows)
            out = pa.record_batch([column(b, "a"), column(b, "b"), pa.array(j)], ["a", "b", "j"])
            yield out.filter(pa.array(j >= least))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(apply, "a long, b long, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def tile_links(group: DataFrame, texts: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """a < b, j: links between different roots, of minor texts with the others of a hub's group.

    group: hub, doc_id, j (similarity to the hub), root, minor.
    """
    step = F.floor(F.col("j") / STEP).cast("int")
    sized = group.withColumn("step", step)
    parts = sized.groupBy("hub", "step", "minor").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    placed = sized.join(parts, ["hub", "step", "minor"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    full = placed.join(texts, "doc_id")
    tiles = full.groupBy("hub", "step", "minor", "part").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("root").alias("roots"), F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    # The tiles of a hub are dealt to g parts on either side, and each of g x g tasks compares one part with one.
    grid = parts.groupBy("hub").agg(F.ceil(F.sum("parts") / GRID).cast("int").alias("g"))
    tiles = tiles.join(grid, "hub")
    own, others = F.pmod(F.xxhash64("step", "part"), F.col("g")).cast("int"), F.sequence(F.lit(0), F.col("g") - 1)
    x = tiles.where("minor").select("hub", own.alias("gx"), F.explode(others).alias("gy"), F.col("step").alias("sx"), *[F.col(c).alias(f"{c}_x") for c in ("ids", "roots", "texts")])
    y = tiles.select("hub", F.explode(others).alias("gx"), own.alias("gy"), F.col("step").alias("sy"), *[F.col(c).alias(f"{c}_y") for c in ("ids", "roots", "texts")])
    reach = int(np.ceil((1 - threshold) / STEP + 1e-9)) + 1
    rows = x.join(y, ["hub", "gx", "gy"]).where(F.abs(F.col("sx") - F.col("sy")) <= reach).drop("hub", "gx", "gy", "sx", "sy")

    def units(t: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, unit) of each text's multiset, an element of count c as c units; sizes."""
        d, e, c = shingles(*buffers(t), SHINGLE)
        level = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        u = mix(np.repeat(e, c) + level.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        d = np.repeat(d, c)
        return d, u, np.bincount(d, minlength=len(t))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: column(batch, c)[i].values for c in batch.schema.names}
                (dx, ux, nx), (dy, uy, ny) = units(at["texts_x"]), units(at["texts_y"])
                # Units that stand in texts of both tiles, as columns of two 0/1 matrices.
                both = np.sort(ux)
                both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
                place = np.minimum(np.searchsorted(both, uy), max(0, len(both) - 1))
                hit = both[place] == uy if len(both) else np.zeros(len(uy), bool)
                overlap = np.zeros((len(nx), len(ny)), np.float32)
                for a in range(0, len(both), 1 << 14):
                    p, q = np.zeros((2, max(len(nx), len(ny)), min(1 << 14, len(both) - a)), np.float32)
                    px = np.searchsorted(both, ux) - a
                    ok = (px >= 0) & (px < p.shape[1])
                    p[dx[ok], px[ok]] = 1
                    ok = hit & (place >= a) & (place < a + q.shape[1])
                    q[dy[ok], place[ok] - a] = 1
                    overlap += p[: len(nx)] @ q[: len(ny)].T
                j = overlap / np.maximum(nx[:, None] + ny[None, :] - overlap, 1)
                ids = [at[f"ids_{s}"].to_numpy() for s in "xy"]
                roots = [at[f"roots_{s}"].to_numpy() for s in "xy"]
                r, c = np.nonzero((j >= threshold) & (roots[0][:, None] != roots[1][None, :]))
                a, b = ids[0][r], ids[1][c]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(j[r, c].astype(np.float64))], ["a", "b", "j"])

    return rows.mapInArrow(apply, "a long, b long, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def links(reps: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(a < b, j: verified links among representatives (doc_id, bands)), (node, root: their components).

    The components are the same whatever `small` is; the links are those that were compared, enough for the components.
    """
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).where("n > 1")
    members = materialize(keys.join(sizes, "key").select("key", "doc_id", "n", "hub"))
    texts = materialize(docs.select("doc_id", "text").join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    few = members.where(F.col("n") <= small).select("key", F.col("doc_id").alias("a"))
    close = few.join(few.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b")  # each row meets small - 1 others at most
    group = members.where(F.col("n") > small).select("hub", "doc_id").distinct()
    star = group.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    tested = materialize(verify(close.unionByName(star).distinct(), texts, 0.0))
    linked = tested.where(F.col("j") >= threshold)
    roots = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = F.coalesce("root", "doc_id").alias("root")
    named = group.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("hub", "doc_id", root)
    per = named.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("hub").agg(F.max(F.struct("k", (-F.col("root")).alias("r"))).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("hub", (-F.col("m.r")).alias("main"))
    # Groups with one main component are one group, and its smallest id is their hub from here on.
    group = materialize(named.join(main, "hub").select(F.col("main").alias("hub"), "doc_id", "root").distinct())
    pair = group.where("hub <> doc_id").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    again = materialize(verify(pair.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts, 0.0))
    known = tested.unionByName(again)
    group = group.withColumn("a", F.least("hub", "doc_id")).withColumn("b", F.greatest("hub", "doc_id")).join(known, ["a", "b"], "left")
    j = F.when(F.col("hub") == F.col("doc_id"), 1.0).otherwise(F.coalesce("j", F.lit(0.0)))
    group = group.withColumn("j", j)
    # Who is linked to the hub is so to its component: not minor any more, but a bridge to those who are.
    minor = ((F.col("root") != F.col("hub")) & (F.col("j") < threshold)).alias("minor")
    group = materialize(group.select("hub", "doc_id", "j", "root", minor))
    linked = linked.unionByName(again.where(F.col("j") >= threshold))
    more = tile_links(group, texts, threshold, tile)
    with batches_of(reps.sparkSession, 16):  # a row holds two tiles of texts
        linked = materialize(linked.unionByName(more))
    return linked, components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and rep_id (of the equal multisets) of every row."""
    sketches = materialize(sketch(docs))
    groups = materialize(sketches.where("doc_id is not null and fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep_id")))
    first = F.min(F.col("bands")).alias("bands")  # equal multisets have equal bands
    reps = sketches.join(groups, "fp").where("doc_id = rep_id").groupBy("doc_id", "fp").agg(first).select("doc_id", "bands")
    roots = links(reps, docs, threshold)[1]
    named = groups.join(roots.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    # A row without words is a class of its own; a key of its own keeps such rows apart in the join.
    key = F.coalesce("fp", F.concat(F.lit(b"row"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string").cast("binary")))
    out = sketches.select("doc_id", key.alias("fp")).join(named, "fp", "left")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep_id", "doc_id"))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", rep)).alias("class_id"), rep.alias("rep_id"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the smallest id of each class, with all their columns."""
    gone = classes(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
