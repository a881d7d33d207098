"""LM scoring by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts of up to ORDER bytes. A byte is coded in the longest context
that the trie has; the chance to escape from a context is d / (n + d) (n occurrences, d different
followers), and symbols that a longer context has are excluded in the shorter ones. The last resort
is the uniform distribution over what is left of 256 symbols; byte 255, which UTF-8 does not use,
stands before the start and for the end of a text. As the trie is fixed after training, the code
length of a byte depends on ORDER + 1 bytes alone, its gram.

All training texts are counted and every context and every token is kept; nothing is cut off.

1. Each task counts the grams and tokens of its texts and sends packed runs of them to the bucket
   of each gram's or token's own hash, so that a frequent one arrives once for each task.
2. A bucket sums them up. Its grams go on to shards of the trie, by the last three bytes of the
   context; what is shorter (2^24 grams of three bytes at most) every shard gets.
3. A block of texts asks the shards for the costs of its distinct grams and the buckets for the
   counts of its distinct tokens, and meets the answers by block.

Numbers travel as packed binary columns: no row is made for a single gram or token.

Defined cases: null is the empty text, which has the end token and the end symbol; repeated rows
of one doc_id are scored as one row each; without training texts every byte costs log10(1/256).
A block is chosen by a hash of id and text, so that ids of any pattern and copies of one text spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, U, buffers, column, fold, from_planes, materialize, mix, planes, steps

ORDER = 5
#: Bytes of text of a block, and of training text for each bucket and shard.
BLOCK_BYTES = 6 << 20
#: Distinct grams and tokens that a task holds before it sends them on.
HELD_GRAMS, HELD_TOKENS = 4 << 20, 400_000
_S = 255
_SPREAD = 0x9E3779B1
GRAM, TOKEN = range(2)
#: One packed row: what it is, its bucket (then shard), keys (of tokens: end to end, with their sizes) and counts; sums of the tokens.
PACKED = "kind int, at int, key binary, size binary, n binary, total long, kinds long"
_ARROW = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = ["kind", "at", "key", "size", "n", "total", "kinds"]
_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(2001, 2257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text between ORDER start symbols and one end symbol; places of the first coded symbol of each text."""
    n = len(offs) - 1
    out = np.full(len(data) + n * (ORDER + 1), _S, np.uint8)
    size = np.diff(offs)
    shift = np.arange(n) * (ORDER + 1) + ORDER
    out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, offs[:-1] + shift


def coded(seq: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each place of the padded texts, from ORDER on, holds a coded symbol."""
    ok = np.ones(max(0, len(seq) - ORDER), bool)
    for k in range(ORDER):  # the start symbols of the next text
        ok[first[1:] - 1 - k - ORDER] = False
    return ok


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Every coded symbol with the ORDER bytes before it, as one number."""
    seq, first = padded(data, offs)
    x = seq.astype(np.int64)
    g = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        g |= x[ORDER - k : len(x) - k] << 8 * k
    return g[coded(seq, first)]


def ranked(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one stretch of symbols after the other: its distinct grams in order, and which of them each symbol's is.

    The bytes that occur get short codes in their order, so that a gram and its place fit in one number to sort.
    """
    seq, first = padded(data, offs)
    present = np.flatnonzero(np.bincount(seq, minlength=256))
    bits = max(1, (len(present) - 1).bit_length())
    code = np.zeros(256, np.uint64)
    code[present] = np.arange(len(present))
    x = code[seq]
    g = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        g |= x[ORDER - k : len(x) - k] << U(bits * k)
    g = g[coded(seq, first)]
    free = 64 - bits * (ORDER + 1)
    size = 1 << min(free, 21)
    for a in range(0, len(g), size):
        key = g[a : a + size] << U(free) | np.arange(min(size, len(g) - a), dtype=np.uint64)
        key.sort()
        v = key >> U(free)
        new = np.append(True, v[1:] != v[:-1])
        which = np.empty(len(key), np.int32)
        which[(key & U((1 << free) - 1)).astype(np.int64)] = np.cumsum(new) - 1
        v = v[new]
        d = np.zeros(len(v), np.int64)
        for k in range(ORDER + 1):
            d |= present[(v >> U(bits * k) & U((1 << bits) - 1)).astype(np.int64)] << 8 * k
        yield d, which


def runs(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often they stand there (or the sums of n)."""
    if n is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, n = x[order], n[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x))) if n is None else np.add.reduceat(n, at) if len(at) else n


def shard_of(g: np.ndarray, n: int) -> np.ndarray:
    """The shard of a gram, by the three bytes before its symbol."""
    return ((g >> 8 & 0xFFFFFF) * _SPREAD >> 20) % n


def bucket_of(g: np.ndarray, n: int) -> np.ndarray:
    return (mix(g.astype(np.uint64) + U(1)) % U(n)).astype(np.int64)


def token_buckets(tokens_: pa.Array, n: int) -> np.ndarray:
    data, offs = buffers(tokens_)
    size = np.diff(offs)
    place = np.arange(len(data)) - np.repeat(offs[:-1], size)
    code = np.append(mix(_BYTE[data] + place.astype(np.uint64)), U(0))
    h = np.where(size > 0, np.add.reduceat(code, offs[:-1]) if len(size) else 0, U(0))
    return (mix(h) % U(n)).astype(np.int64)


def parts(at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by `at` that keeps what is alike in place, and (at, first, end) of each run in it."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    return order, list(zip(at[first].tolist(), first.tolist(), np.append(first[1:], len(at)).tolist()))


def find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted values, and whether they are there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


class Trie:
    """All contexts of a shard: of orders above 2 those whose last three bytes are its own, of 2 and less all there are.

    As followers of a context are followers of every shorter one, what order k excludes is what the
    context of order k + 1 has: sums over contexts tell how much is left to order k.
    """

    def __init__(self, low: tuple[np.ndarray, np.ndarray], g: np.ndarray, n: np.ndarray):
        """low: grams of three bytes and their counts, of all shards; g, n: those of ORDER + 1 bytes of this one."""
        grams_ = {ORDER: runs(g, n), 2: runs(*low)}
        for k in [*range(ORDER - 1, 2, -1), 1, 0]:
            longer, m = grams_[k + 1]
            grams_[k] = runs(longer & ((1 << 8 * (k + 1)) - 1), m)
        self.grams = grams_
        self.contexts = {}
        for k, (own, m) in grams_.items():
            c = own >> 8
            at = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
            below = np.zeros(len(own), np.int64)
            if k:  # how often the follower stands after the context without its first byte
                shorter, m_shorter = grams_[k - 1]
                below = m_shorter[find(shorter, own & ((1 << 8 * k) - 1))[0]] if len(own) else below
            total, excluded = (np.add.reduceat(x, at) if len(at) else x for x in (m, below))
            self.contexts[k] = c[at], total, np.diff(np.append(at, len(c))), excluded

    def cost(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context, with escapes and exclusion."""
        out, escape = np.zeros(len(g)), np.zeros(len(g))
        excluded, kinds_excluded = np.zeros((2, len(g)), np.int64)
        live = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            own = g[live] & ((1 << 8 * (k + 1)) - 1)
            known, totals, sizes, below = self.contexts[k]
            at, seen = find(known, own >> 8)
            pick = lambda x: np.where(seen, x[at], 0) if len(x) else np.zeros(len(live), np.int64)  # noqa: E731, B023
            total, kinds = pick(totals) - excluded[live], pick(sizes) - kinds_excluded[live]
            at_gram, hit = find(self.grams[k][0], own)
            both = np.maximum(total + kinds, 1)
            out[live[hit]] = escape[live[hit]] + np.log10(self.grams[k][1][at_gram[hit]] / both[hit])
            escape[live] += np.where(total > 0, np.log10(np.maximum(kinds, 1) / both), 0.0)
            excluded[live], kinds_excluded[live] = pick(below), pick(sizes)
            live = live[~hit]
        out[live] = escape[live] - np.log10(max(1, 256 - len(self.grams[0][0])))
        return out


# ---- Training ------------------------------------------------------------------------------------


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings that stand end to end in data."""
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts, lower-cased, with an empty one for the end of each text; how many each text has."""
    inside = ~_WHITE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start[heads] = inside[heads]
    start = np.flatnonzero(start)
    of = np.searchsorted(offs, start, "right") - 1
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    n = len(offs) - 1
    size = np.zeros(len(start) + n, np.int64)
    size[np.arange(len(start)) + of] = np.diff(np.append(before[start], before[-1]))
    return binaries(_LOWER[data[inside]], size), np.bincount(of, minlength=n) + 1


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW)], _NAMES)


def gram_rows(g: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[tuple]:
    order, runs_ = parts(at)
    g, n = g[order], n[order]
    return [(GRAM, k, planes(g[a:b]), None, planes(n[a:b]), 0, 0) for k, a, b in runs_]


def token_sums(found: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens and the sums of their counts."""
    coded_ = pa.concat_arrays([x for x, _ in found]).dictionary_encode()
    n = np.concatenate([m for _, m in found])
    return coded_.dictionary, np.bincount(coded_.indices.to_numpy(), n, len(coded_.dictionary)).astype(np.int64)


def cut_tokens(tokens_: pa.Array, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, bytes, bytes]]]:
    """An order by `at`, and (at, first, end, bytes, sizes) of each run of tokens in it."""
    order, runs_ = parts(at)
    data, offs = buffers(tokens_.take(pa.array(order)))
    return order, [(k, a, b, data[offs[a] : offs[b]].tobytes(), planes(np.diff(offs[a : b + 1]))) for k, a, b in runs_]


def token_rows(tokens_: pa.Array, n: np.ndarray, n_buckets: int) -> list[tuple]:
    order, runs_ = cut_tokens(tokens_, token_buckets(tokens_, n_buckets))
    n = n[order]
    return [(TOKEN, k, key, size, planes(n[a:b]), int(n[a:b].sum()), b - a) for k, a, b, key, size in runs_]


def count(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Packed runs of the grams and tokens of each task's texts, for the buckets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[pa.Array, np.ndarray]] = []
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        for b in steps(batches):
            texts = buffers(column(b, "text"))
            pending.append(runs(grams(*texts)))
            own = tokens(*texts)[0].dictionary_encode()
            found.append((own.dictionary, np.bincount(own.indices.to_numpy(), minlength=len(own.dictionary))))
            if len(pending) > 8:
                pending = [runs(*(np.concatenate(x) for x in zip(*pending)))]
                found = [token_sums(found)]
                if len(pending[0][0]) > HELD_GRAMS or len(found[0][0]) > HELD_TOKENS:
                    yield packed(rows(pending, found))
                    pending, found = [], []
        if pending:
            yield packed(rows(pending, found))

    def rows(pending: list[tuple[np.ndarray, np.ndarray]], found: list[tuple[pa.Array, np.ndarray]]) -> list[tuple]:
        g, n = runs(*(np.concatenate(x) for x in zip(*pending)))
        return token_rows(*token_sums(found), n_buckets) + gram_rows(g, n, bucket_of(g, n_buckets))

    return docs.select("text").mapInArrow(apply, PACKED)


def unpacked(t: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[pa.Array, np.ndarray]]]:
    """(grams, counts) and (tokens, counts) of packed rows."""
    grams_, tokens_ = [], []
    for k, key, size, m in zip(*(t[c].to_pylist() for c in ("kind", "key", "size", "n"))):
        if k == GRAM:
            grams_.append((from_planes(key), from_planes(m)))
        else:
            tokens_.append((binaries(np.frombuffer(key, np.uint8), from_planes(size)), from_planes(m)))
    return grams_, tokens_


def merge(t: pa.Table, n: int) -> pa.Table:
    """The sums of a bucket: its grams for their shards, its tokens as one row."""
    rows = []
    grams_, tokens_ = unpacked(t)
    if grams_:
        g, m = runs(*(np.concatenate(x) for x in zip(*grams_)))
        rows = gram_rows(g, m, shard_of(g, n))
    if tokens_:
        rows += token_rows(*token_sums(tokens_), n)
    return pa.Table.from_batches([packed(rows)])


def train(docs: DataFrame, n: int) -> DataFrame:
    """All counts of the training texts, packed, in n buckets and shards; written out."""
    return materialize(count(docs, n).groupBy("at").applyInArrow(lambda t: merge(t, n), PACKED))


def low_orders(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of three bytes (2^24 at most) and their counts: what every shard needs of the others."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = n = np.empty(0, np.int64)
        for b in batches:
            both = [(from_planes(x) & 0xFFFFFF, from_planes(m)) for x, m in zip(column(b, "key").to_pylist(), column(b, "n").to_pylist())]
            if both:
                x, m = (np.concatenate(y) for y in zip(*both))
                g, n = runs(np.append(g, x), np.append(n, m))
        yield pa.record_batch([pa.array(g), pa.array(n)], ["g", "n"])

    t = model.where(F.col("kind") == GRAM).mapInArrow(apply, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return t["g"].to_numpy(), t["n"].to_numpy()


# ---- Scoring -------------------------------------------------------------------------------------


class Asked:
    """Distinct grams by shard and distinct tokens by bucket, in the same order whenever they are made of the same texts."""

    def __init__(self, grams_: np.ndarray, tokens_: pa.Array, n: int):
        """Grams in order, tokens in any."""
        self.grams = grams_
        self.order, self.shards = parts(shard_of(grams_, n))
        by_name = pc.sort_indices(tokens_).to_numpy()
        order, self.buckets = cut_tokens(ordered := tokens_.take(pa.array(by_name)), token_buckets(ordered, n))
        self.token_order = by_name[order]

    def rows(self) -> Iterator[tuple[int, int, bytes, bytes | None]]:
        g = self.grams[self.order]
        for k, a, b in self.shards:
            yield GRAM, k, planes(g[a:b]), None
        for k, _, _, key, size in self.buckets:
            yield TOKEN, k, key, size

    def told(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The costs of the grams, and how often the training texts have the tokens."""
        by = {(k, a): v for k, a, v in zip(t["kind"].to_pylist(), t["at"].to_pylist(), t["value"].to_pylist())}
        cost, seen = np.empty(len(self.grams), np.float32), np.empty(len(self.token_order), np.int64)
        for k, a, b in self.shards:
            cost[self.order[a:b]] = np.frombuffer(by[GRAM, k], np.float32)
        for k, a, b, _, _ in self.buckets:
            seen[self.token_order[a:b]] = from_planes(by[TOKEN, k])
        return cost, seen


def union(parts_: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts_)) if parts_ else np.empty(0, np.int64)


class Block:
    """A block's texts as numbers: of each symbol its gram, of each token its word."""

    def __init__(self, t: pa.Table):
        self.steps = list(steps(iter(t.combine_chunks().to_batches())))
        texts = [buffers(column(b, "text")) for b in self.steps]
        self.ranks = [list(ranked(*x)) for x in texts]
        self.grams = union([d for r in self.ranks for d, _ in r])
        own = [tokens(*x) for x in texts]
        self.sizes = [size for _, size in own]
        coded_ = pa.concat_arrays([x for x, _ in own]).dictionary_encode()
        self.tokens = coded_.dictionary
        self.words = np.split(coded_.indices.to_numpy(), np.cumsum([len(x) for x, _ in own])[:-1])

    def score(self, cost: np.ndarray, seen: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each step: its rows, and of each text the sum of the costs, tokens, known tokens and the sum of log10(count + 1)."""
        logs = np.log10(seen + 1.0)
        for b, ranks, words_, size in zip(self.steps, self.ranks, self.words, self.sizes):
            each = np.concatenate([cost[np.searchsorted(self.grams, d)][which] for d, which in ranks]).astype(np.float64)
            symbols, start = np.diff(buffers(column(b, "text"))[1]) + 1, np.cumsum(size) - size
            known = (seen[words_] > 0).astype(np.int64)
            yield b, np.add.reduceat(each, np.cumsum(symbols) - symbols), size, np.add.reduceat(known, start), np.add.reduceat(logs[words_], start)


def answers(slim: DataFrame, model: DataFrame, low: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """block, kind, at, value: for each block the costs and counts it asks for, in its order."""
    shared = slim.sparkSession.sparkContext.broadcast(low)
    def ask(t: pa.Table) -> pa.Table:
        found, words_ = [], []
        for b in steps(iter(t.combine_chunks().to_batches())):
            texts = buffers(column(b, "text"))
            found.append(runs(grams(*texts))[0])
            words_.append(tokens(*texts)[0].unique())
        rows = list(Asked(union(found), pa.concat_arrays(words_).unique(), n).rows())
        cols = [[t["block"][0].as_py()] * len(rows), *([r[k] for r in rows] for k in range(4))]
        return pa.table([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "at", "key", "size"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, keys, sizes = (left[c].to_pylist() for c in ("kind", "key", "size"))
        grams_, tokens_ = unpacked(right)
        asked = {i: from_planes(x) for i, (k, x) in enumerate(zip(kind, keys)) if k == GRAM}
        if asked:
            none = np.empty(0, np.int64)
            trie = Trie(shared.value, *(np.concatenate(x) for x in zip(*grams_ or [(none, none)])))
            all_ = union(list(asked.values()))
            cost = trie.cost(all_).astype(np.float32)
        known, counts = token_sums(tokens_ or [(binaries(np.empty(0, np.uint8), np.empty(0, np.int64)), np.empty(0, np.int64))])
        counts = np.append(counts, 0)  # of what is not known
        values = []
        for i, (key, size) in enumerate(zip(keys, sizes)):
            if i in asked:
                values.append(cost[np.searchsorted(all_, asked[i])].tobytes())
            else:
                at = pc.index_in(binaries(np.frombuffer(key, np.uint8), from_planes(size)), value_set=known)
                values.append(planes(counts[pc.fill_null(at, len(known)).to_numpy()]))
        return pa.table([left["block"], left["kind"], left["at"], pa.array(values, pa.binary())], ["block", "kind", "at", "value"])

    asks = slim.groupBy("block").applyInArrow(ask, "block int, kind int, at int, key binary, size binary")
    return asks.groupBy("at").cogroup(model.groupBy("at")).applyInArrow(answer, "block int, kind int, at int, value binary")


def score(docs: DataFrame, train_docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every document row."""
    size = F.sum(F.octet_length("text")).alias("n")
    n, n_train = (max(1, -(-(df.agg(size).first()["n"] or 0) // block_bytes)) for df in (docs, train_docs))
    n = max(n, n_train)
    model = train(train_docs, n)
    sums = model.where(F.col("kind") == TOKEN).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_tokens, scale = sums["n"], float(np.log10(sums["n"] + sums["v"] + 1))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    # Asking and scoring read the same exchange of the texts by block.
    slim = docs.select(block, F.col("doc_id").cast("long").alias("doc_id"), "text")
    said = answers(slim, model, low_orders(model), n)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        told = Asked(block.grams, block.tokens, n).told(right)
        out = []
        for b, total, size, known, logs in block.score(*told):
            cols = [column(b, "doc_id"), size, known, np.full(len(size), n_tokens), logs - size * scale, total, np.diff(buffers(column(b, "text"))[1])]
            out.append(pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(cols, kinds)], names))
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], k) for k in kinds], names)

    return slim.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(apply, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def training(docs: DataFrame) -> DataFrame:
    return docs.where((fold("doc_id", 7) != 2) | F.col("doc_id").isNull())
