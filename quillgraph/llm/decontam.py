"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a few MB of documents. Its words become the numbers that the test set gives them (0:
no word of the test set), the suffixes that can hold a match are sorted into a suffix array (a word
that the test set does not have ends a suffix, as no match goes past it), and every test suffix is
binary-searched in it, suffixes of one window together. Where a document has a window, the longest
verbatim match is the one next to the document's suffix in the order of the test suffixes.

Window: `window` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: null and empty texts and items have no words and match nothing; repeated item rows
count once; repeated document rows are each reported; an empty test set hits nothing, and of no documents nothing
is reported. Of items that match alike the smallest id is named. A very long text is a shard of its own.
Columns of documents beside doc_id and text are not read by find(), and pass through clean() whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, column, filter_by_text, materialize, steps, words

WINDOW = 13
#: A document of which this share of words is hit is contaminated.
SHARE = 0.05
#: Bytes of test text that are sent to the executors at once; a larger test set is searched in such blocks.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 6 << 20

HIT = "struct<item_id:bigint,doc_start:int,item_start:int,n_words:int>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))


class TestSet:
    """The test suffixes of one block, with words as numbers, and the windows that they start with."""

    __test__ = False

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.window, self.number = window, {}
        lists = [[self.number.setdefault(w, len(self.number) + 1) for w in words(text)] for _, text in items]
        size = np.array([len(x) for x in lists], np.int64)
        offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])  # a 0 after each item
        ids = np.zeros(offs[-1], np.uint32)
        for a, x in zip(offs.tolist(), lists):
            ids[a : a + len(x)] = x
        self.raw = [np.array(x, ">u4").tobytes() for x in lists]
        # Suffixes in order of all their words, so that those of one window stand together.
        at, keys = suffix_array(ids, window, 1)
        of = np.searchsorted(offs, at, "right") - 1
        place, length = at - offs[of], np.minimum(window, size[of])
        some = np.flatnonzero(place + length <= size[of])
        of, self.place, keys, length = of[some], place[some], keys[some], length[some]
        self.of, self.names = of, np.array([i for i, _ in items], np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.first, self.end = first, np.append(first[1:], len(keys))
        self.keys, self.length = keys[first], length[first]
        self.least = int(length.min()) if len(length) else 0
        # A shorter item is a prefix of the suffixes it matches: its upper end is filled with the largest number.
        fill = self.keys.view(">u4").astype(np.uint32).reshape(-1, window)
        fill[np.arange(window) >= self.length[:, None]] = 0xFFFFFFFF
        self.upper = pack(fill)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, number of the window) of every window that occurs, each place once for each window."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.least or not len(ids):
            return none
        start, key = suffix_array(ids, self.window, self.least)
        if not len(start):
            return none
        low, high = np.searchsorted(key, self.keys, "left"), np.searchsorted(key, self.upper, "right")
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return start[np.repeat(low, count) + within], which

    def items(self, window: int) -> list[int]:
        """The items that have a window."""
        return self.names[self.of[self.first[window] : self.end[window]]].tolist()

    def tail(self, k: int) -> bytes:
        """The numbers of a test suffix as bytes."""
        return self.raw[self.of[k]][4 * self.place[k] :]

    def longest(self, window: int, text: bytes) -> tuple[int, int, int]:
        """(item, its place, words) of the longest verbatim match of a suffix (numbers as bytes) among those that start with the window.

        It is next to where the suffix stands in their order. Of items that match alike the smallest is named, and its first place.
        """
        a, b = int(self.first[window]), int(self.end[window])
        i = bisect_left(range(b), text, a, b, key=self.tail)
        n = max(common(self.tail(k), text) for k in range(max(a, i - 1), min(b, i + 1)))
        low = bisect_left(range(b), text[: 4 * n], a, b, key=self.tail)
        high = bisect_left(range(b), text[: 4 * n] + b"\xff" * 4, low, b, key=self.tail)
        names, places = self.names[self.of[low:high]], self.place[low:high]
        best = np.lexsort((places, names))[0]
        return int(names[best]), int(places[best]), n


def common(a: bytes, b: bytes) -> int:
    """Numbers of four bytes that two strings have in common at their start."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n))
    return int(differ[0]) if len(differ) else n


def suffix_array(ids: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes that go on for `least` words or more before the first 0, in order of their words up to
    it, and the first `window` words of each as a key.

    Suffixes are sorted by that many words first; those alike are ranked on by twice as many words, and
    again, until no two are alike or the longest has ended.
    """
    gap = np.append(np.flatnonzero(ids == 0), len(ids))
    at = np.arange(len(ids))
    end = gap[np.searchsorted(gap, at)]
    begin = np.append(-1, gap)[np.searchsorted(gap, at)] + 1
    place = np.flatnonzero(end - begin >= least)
    if not len(place):
        return place, np.empty(0, f"S{4 * window}")
    run = (end - at)[place]
    body = np.append(ids, np.zeros(window, np.uint32))[place[:, None] + np.arange(window)]
    body[np.arange(window) >= run[:, None]] = 0
    key = pack(body)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[place[order]] = np.maximum.accumulate(np.where(new, np.arange(1, len(order) + 1), 0))
    reach = window
    while True:
        r = rank[place[order]]
        same = r[1:] == r[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        tied = tied[run[order[tied]] > reach] if len(tied) else tied
        if not len(tied):
            break
        groups = np.flatnonzero(np.append(same, False) | np.append(False, same))  # with those that have ended, which come first
        own = order[groups]
        beyond = np.where(run[own] > reach, rank[np.minimum(place[own] + reach, len(ids))], 0)
        by = np.lexsort((beyond, rank[place[own]]))
        order[groups] = own[by]
        r, b = rank[place[own]][by], beyond[by]
        new = np.append(True, (r[1:] != r[:-1]) | (b[1:] != b[:-1]))
        rank[place[order[groups]]] = np.maximum.accumulate(np.where(new, groups + 1, 0))
        reach *= 2
    order = order[run[order] >= least]
    return place[order], key[order]


def pack(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    if not rows.size:
        return np.empty(0, f"S{4 * rows.shape[1]}")
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def matches(test: TestSet, texts: list[bytes], every: bool = False) -> tuple[np.ndarray, list[list[int]], list[list[dict]]]:
    """Words of each text, the items of which it has a window, and its longest verbatim matches, which cover all windows.

    From the first place of a window on, the longest match is taken; the next starts with the first
    window that is not inside it. every: the longest match of each place of a window instead, with the
    length of its longest window, from which merged() makes the same of several blocks.
    """
    get = test.number.get
    lists = [[get(w, 0) for w in words(t)] for t in texts]
    n_words = np.array([len(x) for x in lists], np.int64)
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_words + 1)])  # a 0 after each text
    ids = np.zeros(offs[-1], np.uint32)
    for a, x in zip(offs.tolist(), lists):
        ids[a : a + len(x)] = x
    at, which = test.search(ids)
    order = np.lexsort((-test.length[which], at)) if len(at) else at
    at, which = at[order], which[order]
    doc = np.searchsorted(offs, at, "right") - 1
    items: list[list[int]] = [[] for _ in texts]
    hits: list[list[dict]] = [[] for _ in texts]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist() if len(doc) else []
    for x, y in zip(first, [*first[1:], len(doc)]):
        d = int(doc[x])
        items[d] = sorted({i for w in np.unique(which[x:y]).tolist() for i in test.items(w)})
        raw, base, end = np.array(lists[d], ">u4").tobytes(), int(offs[d]), 0
        stops = (at[x:y] - base + test.length[which[x:y]]).tolist()
        last = -1
        for p, w, stop in zip((at[x:y] - base).tolist(), which[x:y].tolist(), stops):
            if stop > end if not every else p != last:
                item, place, n = test.longest(w, raw[4 * p :])
                hits[d].append({"item_id": item, "doc_start": p, "item_start": place, "n_words": n} | ({"window": stop - p} if every else {}))
                end, last = p + n, p
    return n_words, items, hits


def merged(hits: list[dict]) -> list[dict]:
    """The matches that matches() gives for all blocks as one, from those at every place in each of them."""
    at: dict[int, list[dict]] = {}
    for h in hits:
        at.setdefault(h["doc_start"], []).append(h)
    out, end = [], 0
    for p in sorted(at):
        if p + max(h["window"] for h in at[p]) > end:
            best = min(at[p], key=lambda h: (-h["n_words"], h["item_id"], h["item_start"]))
            out.append({k: best[k] for k in ("item_id", "doc_start", "item_start", "n_words")})
            end = p + best["n_words"]
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The test set in parts of about block_bytes, each small enough to send to every task."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    k = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == b) for b in range(k)]


def load(block: DataFrame, window: int = WINDOW) -> TestSet:
    rows = block.distinct().toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return TestSet(list(zip(rows["item_id"].to_pylist(), byte_list(rows["text"].combine_chunks()))), window)


def search(rows: DataFrame, part: DataFrame, window: int = WINDOW, every: bool = False) -> DataFrame:
    """row_no, doc_id, n_words, items and hits (every: as of matches()) in one block of the test set, of rows (row_no, doc_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(load(part, window))
    hit = HIT.replace(">", ",window:int>") if every else HIT
    kind = pa.list_(pa.struct([*_HIT_ARROW.value_type, pa.field("window", pa.int32())])) if every else _HIT_ARROW

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, size=SHARD_BYTES):
            n, items, hits = matches(shared.value, byte_list(column(b, "text")), every)
            yield pa.record_batch([column(b, "row_no"), column(b, "doc_id"), pa.array(n), pa.array(items, pa.list_(pa.int64())), pa.array(hits, kind)], ["row_no", "doc_id", "n_words", "items", "hits"])

    return rows.mapInArrow(apply, f"row_no string, doc_id long, n_words long, items array<long>, hits array<{hit}>")


def search_all(rows: DataFrame, parts: list[DataFrame], window: int = WINDOW) -> DataFrame:
    """The same over all blocks, a pass for each, as if they were one; rows are written out, as row_no must not change."""
    passes = [materialize(search(rows, p, window, every=True)) for p in parts]
    by_row = reduce(DataFrame.unionByName, passes).groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = pa.array([merged(h) for h in column(b, "hits").to_pylist()], _HIT_ARROW)
            yield pa.record_batch([*b.columns[:4], hits], ["row_no", "doc_id", "n_words", "items", "hits"])

    return by_row.mapInArrow(apply, f"row_no string, doc_id long, n_words long, items array<long>, hits array<{HIT}>")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, items (that it has a window of) and hits (longest matches) of every document row.

    A test set of one block is searched in a single pass. A larger one takes a pass for each
    block, so that a task never holds more than one; their hits are then put together by row, so that
    the result does not depend on the blocks.
    """
    parts = blocks(benchmark, block_bytes)
    if len(parts) == 1:
        return search(docs.select(F.lit("").alias("row_no"), "doc_id", "text"), parts[0], window).drop("row_no")
    rows = materialize(docs.select(F.uuid().alias("row_no"), "doc_id", "text"))
    return search_all(rows, parts, window).drop("row_no")


def covered(hits: list[dict]) -> int:
    """Words inside any match."""
    end = n = 0
    for a, k in sorted((h["doc_start"], h["n_words"]) for h in hits):
        n += max(0, a + k - max(a, end))
        end = max(end, a + k)
    return n


def judge(found: DataFrame, share: float = SHARE) -> DataFrame:
    """n_hit (words inside any match), n_items, items_sha256 and contaminated, from n_words, items and hits."""

    def digest(n_words: int, items: list[int], hits: list[dict]) -> tuple[int, int, str, bool]:
        n_hit, names = covered(hits), sorted(map(str, set(items)))
        return n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and n_hit * round(1 / share) >= n_words

    nothing = digest(0, [], [])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, items, hits = column(b, "n_words").to_pylist(), column(b, "items"), column(b, "hits")
            out = [nothing] * b.num_rows
            for i in np.flatnonzero(np.diff(np.asarray(hits.offsets)) > 0).tolist():
                out[i] = digest(n_words[i], items[i].as_py(), hits[i].as_py())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([column(b, "doc_id"), column(b, "n_words"), *cols, hits], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"])

    return found.mapInArrow(apply, f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<{HIT}>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns (rows of a null id stay if clean themselves)."""
    parts = blocks(benchmark, block_bytes)
    if len(parts) > 1:
        # Rows are judged and removed by their own number, which takes the place of the id.
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")))
        found = search_all(rows.select(F.col("number").cast("string").alias("row_no"), F.col("number").alias("doc_id"), "own.text"), parts, window)
        bad = judge(found, share).where("contaminated").select(F.col("doc_id").alias("number"))
        return rows.join(bad, "number", "left_anti").select("own.*")
    shared = docs.sparkSession.sparkContext.broadcast(load(parts[0], window))

    def keep(texts: pa.Array) -> list[bool]:
        n, _, hits = matches(shared.value, byte_list(texts))
        return [not h or covered(h) * round(1 / share) < k for k, h in zip(n.tolist(), hits)]

    return filter_by_text(docs, keep, SHARD_BYTES)
