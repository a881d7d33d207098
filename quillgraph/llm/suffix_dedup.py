"""Suffix-array dedup: remove what repeats, byte for byte, a string of LENGTH bytes of an earlier document.

Every window of LENGTH bytes has an anchor: the smallest hash of its GRAM-byte strings. Equal
windows have equal anchors, so windows of one anchor that follow each other form a segment, and
only segments of one anchor can share a window.

1. Each task cuts its texts into segments and sends (anchor, 64-bit hash of the segment, smallest
   document) to the anchor's bucket. What a task can settle itself (a segment that an earlier
   document of the same task has) it does not send there, so that an anchor of very many documents
   arrives once for each task.
2. A bucket finds the earliest document of every segment. Copies of a segment are settled by that;
   segments that can share a window with another one are called for: those of one anchor that also agree in the
   SIDE bytes before its string or after it, as a window holds one of these. In a large table nearly all short
   strings occur again, so that by their anchors alone nearly all segments would be called for.
3. The texts meet the answers in blocks by document; the segments called for are cut out and go
   to their anchor's bucket. Those of a hot anchor go window by window to the bucket of each window's
   own string, after a block has settled what it can.
4. There the suffixes at every window of these segments are sorted deep-shallow: a multikey
   quicksort by words of eight bytes down to SHALLOW bytes, whose ties (long common prefixes) are put
   in order by a blind trie each. Suffixes with LENGTH bytes in common are one string; it is removed
   from all documents but the earliest.
5. The texts meet all spans, again in blocks by document.

Defined cases: a null text is empty and loses nothing, like any text under LENGTH bytes; a row of a
null id neither loses nor costs anything; rows that repeat an id are of equal rank and do not cost
each other anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, column, discard, from_planes, materialize, mix, planes, setting, steps

LENGTH = 50
GRAM = 16
SHALLOW = 32
#: Distinct segments from which an anchor is hot: its segments go on window by window, each to a bucket of its own.
HOT = 1024
#: Bytes of text of a block, and of the segments of which a bucket holds the keys.
BLOCK_BYTES = 6 << 20
_STEP = 1 << 20
#: Bytes before or after an anchor's string: a window that holds fewer on the one side holds as many on the other.
SIDE = (LENGTH - GRAM) // 2
#: In 16 bits for a side: no window of the segment has all of it; and the string occurs again in the segment, which may then share a window with any of its anchor.
_NONE, _ANY = 0, 0xFFFF
#: Bytes of text whose segments, or which themselves, a task sends at once: each bucket or block gets one packed row of them.
_EMIT = 16 << 20

_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: One packed row: to (bucket or block), what it is, and columns of numbers as bytes.
PACKED = "to int, kind int, g binary, h binary, doc binary, row binary, a binary, b binary, text binary"
_NAMES = ["to", "kind", "g", "h", "doc", "row", "a", "b", "text"]
_KINDS = [pa.int32(), pa.int32()] + [pa.binary()] * 7
KEY, ANSWER, SEGMENT, SPAN = range(4)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            p = np.full(max(n, _STEP + 4096), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def segments(data: np.ndarray, offs: np.ndarray, with_sides: bool = False) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, hash of the bytes) of each segment, and if asked for its two sides; windows as places in data."""
    n = len(data)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    none += (np.empty((0, 2), np.uint16),) * with_sides
    if n < LENGTH:
        return none
    code = _BYTE[data]
    g = code
    width = 1
    while width < GRAM:
        g = mix(g[:-width] * U(0xD1342543DE82EF95) + g[width:])
        width *= 2
    span = LENGTH - GRAM + 1  # grams in a window
    low, width = g, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    m = n - LENGTH + 1
    anchor = np.minimum(low[:m], low[span - width : span - width + m])
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:m]
    inside = np.flatnonzero(np.arange(m) + LENGTH <= offs[1:][text])
    if not len(inside):
        return none
    anchor, text = anchor[inside], text[inside]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    at = np.flatnonzero(new)
    first, last = inside[at], inside[np.append(at[1:], len(inside)) - 1]
    p, inverse = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(code * p[:n], out=run[1:])
    h = mix((run[last + LENGTH] - run[first]) * inverse[first] + (last - first).astype(np.uint64))
    out = text[at], first, last, anchor[at], h
    return (*out, sides(g, run, inverse, *out[1:4])) if with_sides else out


def sides(g: np.ndarray, run: np.ndarray, inverse: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """16 bits for the SIDE bytes before and after the anchor's string of each segment; like its hash they depend on its bytes alone."""
    grams = np.lib.stride_tricks.sliding_window_view(g.astype(np.uint32), LENGTH - GRAM + 1)
    own = anchor.astype(np.uint32)[:, None]
    low = first + (grams[first] == own).argmax(axis=1)
    high = last + LENGTH - GRAM - (grams[last][:, ::-1] == own).argmax(axis=1)
    out = np.empty((len(first), 2), np.uint16)
    for k, (a, there) in enumerate(((low - SIDE, low - SIDE >= first), (low + GRAM, low + GRAM + SIDE <= last + LENGTH))):
        a = np.where(there, a, first)
        h = mix((run[a + SIDE] - run[a]) * inverse[a]) % U(_ANY - 1) + U(1)
        out[:, k] = np.where(there, h, _NONE)
    out[low != high] = _ANY
    return out


def short(g: np.ndarray) -> np.ndarray:
    """32 bits of an anchor, as it is sent: with its bucket they tell anchors apart, and of two that they take for one
    the segments still differ by their 64-bit hashes, or are compared byte by byte."""
    return mix(g).astype(np.uint32)


def identity(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(g.astype(np.uint64)) + mix(h + U(0x632BE59BD9B4E019))


def copies(g: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which copies (equal anchor and hash) stand together by document, the identities in it, and where a new segment starts."""
    ident = identity(g, h)
    for keys_ in ((doc, ident), (doc, h, g, ident)):  # the second only if different segments have one identity
        order = np.lexsort(keys_)
        i, a, b = ident[order], g[order], h[order]
        differ = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if not (differ & (i[1:] == i[:-1])).any():
            break
    return order, i, np.append(True, differ)[: len(g)]


def block_of(doc: np.ndarray, n: int) -> np.ndarray:
    """The block of a document: Spark's hash() of its id modulo n, so that ids of any pattern spread."""
    x = doc.astype(np.int64).view(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    for k in (x.astype(np.uint32), (x >> U(32)).astype(np.uint32)):
        k = k * np.uint32(0xCC9E2D51)
        h ^= (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % n


def bucket_of(g: np.ndarray, n: int) -> np.ndarray:
    return (mix(g ^ U(0x2545F4914F6CDD1D)) % U(n)).astype(np.int64)


def pack(kind: int, to: np.ndarray, **cols: np.ndarray) -> list[tuple]:
    """Packed rows, one for each value of `to`; keys and answers in order of the document."""
    order = np.lexsort((cols["doc"], to)) if kind in (KEY, ANSWER) else np.argsort(to, kind="stable")
    to = to[order]
    at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
    cols = {k: v[order] for k, v in cols.items()}
    ends = np.append(at[1:], len(to)) if len(to) else []
    write = {"doc": planes}
    return [(int(to[a]), kind, *(write.get(k, np.ndarray.tobytes)(cols[k][a:b]) if k in cols else None for k in _NAMES[2:])) for a, b in zip(at, ends)]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    pa.default_memory_pool().release_unused()  # of the block or bucket before
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def unpack(t: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """The columns of all rows of a kind, end to end."""
    t = t.filter(pa.array(t["kind"].to_numpy() == kind))
    types = {"g": np.uint32, "h": np.uint64, "doc": np.int64, "row": np.int64, "a": np.int32, "b": np.int32, "text": np.uint8}
    read = {"doc": lambda x: from_planes(x).tobytes()}
    return {k: np.frombuffer(b"".join(read.get(k, bytes)(x) for x in t[k].to_pylist() if x is not None), v) for k, v in types.items()}


def called_for(g: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """1 for each of distinct segments (short anchor, sides, first and last document) that can share a window with another one of another document, 2 if its anchor is hot, else 0."""
    out = np.zeros(len(g), np.int32)

    def groups(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = at[np.argsort(key[at], kind="stable")]
        start = np.flatnonzero(np.append(True, np.diff(key[at]) != 0)) if len(at) else np.empty(0, np.int64)
        return at, start, np.diff(np.append(start, len(at)))

    def call(at: np.ndarray, start: np.ndarray, count: np.ndarray, some: np.ndarray | bool = True) -> None:
        if len(at):
            spread = np.minimum.reduceat(low[at], start) < np.maximum.reduceat(high[at], start)
            out[at[np.repeat((count > 1) & spread & some, count)]] = 1

    for s in side.T:
        call(*groups(np.flatnonzero((s != _NONE) & (s != _ANY)), g.astype(np.int64) << 16 | s))
    again = np.isin(g, g[side[:, 0] == _ANY])
    call(*groups(np.flatnonzero(again), g))
    at, _, count = groups(np.flatnonzero(out), g)
    out[at] += np.repeat((count > HOT).astype(np.int32), count)
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """block, size, rows: what a task has for a block as one Arrow stream, compressed: texts shrink far more so than among the rows of a shuffle."""

    def send(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        to = t["block"].to_numpy()
        order = np.argsort(to, kind="stable")
        t, to = t.take(pa.array(order)).combine_chunks(), to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
        zstd, out = pa.Codec("zstd", compression_level=3), []
        for a, b in zip(at, at[1:] + [len(to)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as stream:
                stream.write_table(t.slice(a, b - a))
            raw = sink.getvalue()
            out.append((int(to[a]), raw.size, zstd.compress(raw, asbytes=True)))
        pa.default_memory_pool().release_unused()
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["block", "size", "rows"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > _EMIT:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return rows.mapInArrow(apply, "block int, size long, rows binary")


def rows_of(sent: pa.Table) -> pa.Table | None:
    """The rows of a block, from blocks()."""
    zstd = pa.Codec("zstd")
    parts = [pa.ipc.open_stream(zstd.decompress(r.as_buffer(), decompressed_size=n.as_py())).read_all() for r, n in zip(sent["rows"], sent["size"])]
    return pa.concat_tables(parts) if parts else None


# ---- 1 and 2: segments --------------------------------------------------------------------------


def keys(docs: DataFrame, n_buckets: int, n_blocks: int) -> DataFrame:
    """Packed KEY rows for the buckets, and ANSWER rows (with their block in column b) that pass them."""

    def settle(parts: list[tuple]) -> pa.RecordBatch:
        g, h, side, doc = (np.concatenate(x) for x in zip(*parts))
        order, _, new = copies(g, h, doc)
        g, h, side, doc = g[order], h[order], side[order], doc[order]
        at = np.flatnonzero(new)
        low = np.repeat(doc[at], np.diff(np.append(at, len(doc))))
        rows = pack(KEY, bucket_of(g[new], n_buckets), g=short(g[new]), h=h[new], doc=doc[new], text=side[new])
        own = doc != low
        answers = pack(ANSWER, block_of(doc[own], n_blocks), g=short(g[own]), h=h[own], doc=low[own], a=np.zeros(own.sum(), np.int32))
        rows += [(r[0] % n_buckets, *r[1:7], np.int32(r[0]).tobytes(), None) for r in answers]
        return batch(rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in steps(batches, size=_STEP):
            data, offs = buffers(column(b, "text"))
            text, _, _, g, h, side = segments(data, offs, with_sides=True)
            parts.append((g, h, side, column(b, "doc_id").to_numpy()[text]))
            size += len(data)
            if size > _EMIT:
                yield settle(parts)
                parts, size = [], 0
        if parts:
            yield settle(parts)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, PACKED)


def answers(packed: DataFrame, n_blocks: int) -> DataFrame:
    """For the blocks: the earliest document (doc) of segments that have an earlier one or are called for (a = 1, 2 if hot)."""

    def apply(t: pa.Table) -> pa.Table:
        out = []
        for r in t.filter(pa.array(t["kind"].to_numpy() == ANSWER)).to_pylist():
            out.append((int(np.frombuffer(r["b"], np.int32)[0]), ANSWER, r["g"], r["h"], r["doc"], None, r["a"], None, None))
        k = unpack(t, KEY)
        g, h, doc, side = k["g"], k["h"], k["doc"], k["text"].view(np.uint16).reshape(-1, 2)
        if len(g):
            order, _, new = copies(g, h, doc)
            g, h, doc, side = g[order], h[order], doc[order], side[order]
            at = np.flatnonzero(new)
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(g))))
            low, high = doc[at], doc[np.append(at[1:], len(g)) - 1]
            called = called_for(g[at], side[at], low, high)
            earliest = doc == low[group]
            say = ~earliest | (called[group] > 0)
            flag = np.where(earliest, called[group], 0).astype(np.int32)
            out += pack(ANSWER, block_of(doc[say], n_blocks), g=g[say], h=h[say], doc=low[group][say], a=flag[say])
        return pa.Table.from_batches([batch(out)])

    return packed.groupBy("to").applyInArrow(apply, PACKED)


# ---- 3: texts and answers -----------------------------------------------------------------------


def windows_of(whole: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, place: np.ndarray, count: np.ndarray, block: int, n_buckets: int) -> list[tuple]:
    """Packed rows of hot segments, window by window: the earliest document of a string within the block goes to the
    bucket of the string itself, all others are settled. A string reaches its bucket once for each block at most,
    but for its repetitions in one document."""
    of = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = place[of] + within
    h = np.zeros(len(at), np.uint64)
    for k in range(LENGTH):
        h = h * U(_P) + _BYTE[whole[at + k]]
    h = mix(h)
    order = np.lexsort((doc[of], h))
    of, within, at, h = of[order], within[order], at[order], h[order]
    d, r, a = doc[of], row[of], (first[of] + within).astype(np.int32)
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    low = np.repeat(d[start], np.diff(np.append(start, len(h))))
    later = d > low
    out = pack(SPAN, np.full(int(later.sum()), block), doc=d[later], row=r[later], a=a[later], b=a[later] + np.int32(LENGTH))
    go = np.flatnonzero(~later)
    to = bucket_of(h[go], n_buckets)
    go, to = go[np.argsort(to, kind="stable")], np.sort(to)
    ends = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    packed = pack(SEGMENT, to, doc=d[go], row=r[go], a=a[go], b=np.ones(len(go), np.int32))
    for x, i, j in zip(packed, ends, np.append(ends[1:], len(to))):
        out.append((*x[:8], whole[at[go[i:j], None] + np.arange(LENGTH)].tobytes()))
    return out


def cut(rows: DataFrame, said: DataFrame, n_buckets: int) -> DataFrame:
    """SPAN rows of the settled segments, for the blocks, and SEGMENT rows of those called for, for the buckets."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left)
        if rows is None:
            return pa.Table.from_batches([batch([])])
        block = rows["block"][0].as_py()
        datas, parts, base = [], [], 0
        for b in steps(iter(rows.combine_chunks().to_batches()), size=_STEP):
            data, offs = buffers(column(b, "text"))
            ids = column(b, "doc_id")
            text, first, last, g, h = segments(data, offs)
            if ids.null_count:
                keep = np.asarray(ids.is_valid())[text]
                text, first, last, g, h = (x[keep] for x in (text, first, last, g, h))
                ids = ids.fill_null(0)
            parts.append((ids.to_numpy()[text], column(b, "row").to_numpy()[text], first - offs[text], last - offs[text], first + base, g, h))
            datas.append(data)
            base += len(data)
        doc, row, first, last, place, g, h = (np.concatenate(x) for x in zip(*parts))
        if not len(doc):
            return pa.Table.from_batches([batch([])])
        sent = short(g)
        ident = identity(sent, h)
        low = doc.copy()
        called = np.zeros(len(doc), np.int32)
        # the earliest document within the block
        order, _, new = copies(g, h, doc)
        at = np.flatnonzero(new)
        low[order] = np.repeat(doc[order][at], np.diff(np.append(at, len(doc))))
        k = unpack(right, ANSWER)
        if len(k["g"]):
            order, known, new = copies(k["g"], k["h"], k["doc"])
            other, flag = k["doc"][order], k["a"][order]
            at = np.flatnonzero(new)
            known, known_g, known_h = known[at], k["g"][order][at], k["h"][order][at]
            other, flag = other[at], np.maximum.reduceat(flag, at)
            found = np.minimum(np.searchsorted(known, ident), len(known) - 1)
            while True:  # past other segments of the same identity
                differ = (known_g[found] != sent) | (known_h[found] != h)
                past = np.flatnonzero(differ & (known[found] == ident) & (found < len(known) - 1))
                past = past[known[found[past] + 1] == ident[past]]
                if not len(past):
                    break
                found[past] += 1
            hit = ~differ
            low[hit] = np.minimum(low[hit], other[found[hit]])
            called[hit] = flag[found[hit]]
        done = np.flatnonzero(low < doc)
        out = []
        if len(done):
            d, r, a, b = doc[done], row[done], first[done], last[done] + LENGTH
            new = np.append(True, (place[done][1:] - a[1:] != place[done][:-1] - a[:-1]) | (a[1:] > b[:-1]))
            at = np.flatnonzero(new)
            b = b[np.append(at[1:], len(b)) - 1]
            out += pack(SPAN, np.full(len(at), block), doc=d[at], row=r[at], a=a[at].astype(np.int32), b=b.astype(np.int32))
        hot = np.flatnonzero((called == 2) & (low == doc))
        if len(hot):
            out += windows_of(np.concatenate(datas), doc[hot], row[hot], first[hot], place[hot], (last - first + 1)[hot], block, n_buckets)
        ask = np.flatnonzero((called == 1) & (low == doc))
        if len(ask):
            to = bucket_of(g[ask], n_buckets)
            order = np.argsort(to, kind="stable")
            ask, to = ask[order], to[order]
            windows = (last - first + 1)[ask]
            size = windows + LENGTH - 1
            whole = np.concatenate(datas)
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            packed = pack(SEGMENT, to, doc=doc[ask], row=row[ask], a=first[ask].astype(np.int32), b=windows.astype(np.int32))
            for r, a, b in zip(packed, at, np.append(at[1:], len(to))):
                s = size[a:b]
                bytes_ = whole[np.repeat(place[ask[a:b]], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)]
                out.append((*r[:8], bytes_.tobytes()))
        return pa.Table.from_batches([batch(out)])

    return blocks(rows).groupBy("block").cogroup(said.groupBy("to")).applyInArrow(apply, PACKED)


# ---- 4: deep-shallow sorting --------------------------------------------------------------------


class BlindTrie:
    """Strings of one length in order. An inner node [depth, children] knows only where and by which byte its
    children part; a string goes down blindly, and one comparison with the leaf it meets tells its place."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, s: bytes) -> None:
        if self.root is None:
            self.root = [-1, s]
            return
        node = self.root
        while node[0] >= 0:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = node[1]
        if other == s:
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [-1, s]
            return
        inner = [depth, {other[depth]: node, s[depth]: [-1, s]}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def leaves(self) -> Iterator[bytes]:
        stack = [self.root] if self.root else []
        while stack:
            depth, rest = stack.pop()
            if depth < 0:
                yield rest
            else:
                stack += [rest[k] for k in sorted(rest, reverse=True)]


def deep_shallow(text: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at the places in order, as (index in place, number of the string of LENGTH bytes it starts with).

    Suffixes that share no such string with one of another document are left out.
    """
    x = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << U(8 * width) | x[width:]
    index, group = np.arange(len(place)), np.zeros(len(place), np.int64)
    for depth in range(0, SHALLOW, 8):
        word = x[place[index] + depth]
        order = np.lexsort((word, group))
        index, group, word = index[order], group[order], word[order]
        if not len(index):
            return index, group
        at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        size = np.diff(np.append(at, len(index)))
        d = doc[index]
        some = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
        keep = np.repeat(some, size)
        index, group = index[keep], np.repeat(np.arange(some.sum()), size[some])
    if not len(index):
        return index, group
    raw, at = text.tobytes(), np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
    tails = [raw[p + SHALLOW : p + LENGTH] for p in place[index].tolist()]
    number = np.empty(len(index), np.int64)
    count = 0
    for a, b in zip(at, at[1:] + [len(tails)]):
        own = tails[a:b]
        first = own[0]
        if own.count(first) == b - a:
            number[a:b] = count
            count += 1
            continue
        trie = BlindTrie()
        for s in set(own):
            trie.insert(s)
        rank = {s: count + k for k, s in enumerate(trie.leaves())}
        number[a:b] = [rank[s] for s in own]
        count += len(rank)
    order = np.argsort(number, kind="stable")
    return index[order], number[order]


def compare(cuts: DataFrame, n_blocks: int) -> DataFrame:
    """SPAN rows, for the blocks, of the windows that an earlier document has, among the segments of each bucket."""

    def apply(t: pa.Table) -> pa.Table:
        k = unpack(t, SEGMENT)
        if not len(k["doc"]):
            return pa.Table.from_batches([batch([])])
        windows = k["b"].astype(np.int64)
        size = windows + LENGTH - 1
        of = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = (np.cumsum(size) - size)[of] + within
        index, string = deep_shallow(k["text"], place, k["doc"][of])
        if not len(index):
            return pa.Table.from_batches([batch([])])
        at = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
        d = k["doc"][of[index]]
        later = d > np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(d))))
        hit = np.sort(index[later])
        if not len(hit):
            return pa.Table.from_batches([batch([])])
        new = np.append(True, (of[hit][1:] != of[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(hit)) - 1
        s = of[hit[a]]
        doc = k["doc"][s]
        start, end = k["a"][s] + within[hit[a]], k["a"][s] + within[hit[b]] + LENGTH
        return pa.Table.from_batches([batch(pack(SPAN, block_of(doc, n_blocks), doc=doc, row=k["row"][s], a=start.astype(np.int32), b=end.astype(np.int32)))])

    return cuts.where(F.col("kind") == SEGMENT).groupBy("to").applyInArrow(apply, PACKED)


# ---- 5: removal ---------------------------------------------------------------------------------


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, and maximal removed runs."""
    kept, end, gone, runs = [], 0, 0, 0
    for a, b in sorted(spans):
        if b <= end:
            continue
        if a > end or not runs:
            kept.append(text[end:a])
            runs += 1
            gone += b - a
        else:
            gone += b - end
        end = b
    kept.append(text[end:])
    return b"".join(kept), gone, runs


def repeats(docs: DataFrame, output: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema) -> DataFrame:
    """output(rows, spans of each row) over blocks of docs; rows have the columns of docs, and block and row.

    The spans may overlap or touch.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    row = F.coalesce(F.xxhash64("text"), F.lit(0))
    block = F.pmod(F.hash(F.coalesce(F.col("doc_id").cast("long"), row)), F.lit(n)).cast("int")
    slim = docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    with setting(docs.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
        said = materialize(answers(keys(docs, n, n), n))  # by itself: the keys leave the disk before the texts are sent
        cuts = materialize(cut(slim, said, n))
        discard(said)
    spans = cuts.where(F.col("kind") == SPAN).unionByName(compare(cuts, n))
    own = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), block.alias("block"), row.alias("row"))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        k = unpack(right, SPAN)
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, r, a, b in zip(*(k[c].tolist() for c in ("doc", "row", "a", "b"))):
            by.setdefault((d, r), []).append((a, b))
        rows = rows_of(left)
        if rows is None:
            return pa.table({})
        t = pa.Table.from_arrays(rows["own"].combine_chunks().flatten(), own)
        return output(t, [by.get(x, []) for x in zip(t["doc_id"].to_pylist(), rows["row"].to_pylist())])

    return blocks(whole).groupBy("block").cogroup(spans.groupBy("to")).applyInArrow(apply, schema)


def _bytes(t: pa.Table) -> list[bytes]:
    return [x.encode() if x is not None else b"" for x in t["text"].to_pylist()]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document row."""

    def output(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        rows = []
        for text, s in zip(_bytes(t), spans):
            kept, gone, runs = remove(text, s)
            rows.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = [t["doc_id"].cast(pa.int64()), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))]
        return pa.table(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs.select("doc_id", "text"), output, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with what repeats removed from text (bytes of a character cut in two go too); n_chars, if there, follows."""
    schema = docs.schema

    def output(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        texts = t["text"].to_pylist()
        for k, s in enumerate(spans):
            if s:
                texts[k] = remove(texts[k].encode(), s)[0].decode("utf-8", "ignore")
        i = t.schema.get_field_index("text")
        t = t.set_column(i, "text", pa.array(texts, pa.string()))
        i = t.schema.get_field_index("n_chars")
        if i >= 0 and pa.types.is_integer(t.schema.field(i).type):
            old = t["n_chars"].to_pylist()
            t = t.set_column(i, "n_chars", pa.array([len(x) if s else n for x, n, s in zip(texts, old, spans)], t.schema.field(i).type))
        return t

    return repeats(docs, output, schema)
