"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Whether an n-gram (hashed) stands in a text is its feature; its value is the log of the ratio of
the smoothed shares of toxic and other texts that have it. A feature tells as much as this ratio,
taken as positive, times the difference of the two shares. A logistic regression over all features
that tell TELLING or more, however many, is fitted on labelled texts. Scores use every n-gram of
the whole text.

Defined cases: a null or empty text has no features and gets the score of the intercept; labels
that are null are no labels; several label rows of one document count once (the larger label);
without labels of both kinds the score is the constant share of toxic ones. Repeated rows of a
labelled document are one training row each; texts alike have scores alike, whatever their id; a
text of any length is scored as a whole, by which n-grams it has and not how often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, codepoints, column, from_planes, letter_table, materialize, planes, steps
from .quality import labelled

#: Lengths of the n-grams.
ORDERS = (4, 6, 8, 10, 12)
BITS = 22
#: Buckets that are summed together, as a power of two.
RANGE_BITS = 16
#: Labelled rows that the model is fitted on at most: those of the smallest hash of the id.
MAX_TRAIN_ROWS = 20_000
#: What a feature tells at least. Shares of all features of a text sum up to its distinct n-grams, which bounds their number.
TELLING = 0.06
_STEP = 1 << 20


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every n-gram of letters; runs of anything else are one space."""
    cp, offs = codepoints(texts)
    is_letter = letter_table()[cp]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offs))
    c = np.where(is_letter, cp, 32).astype(np.uint64)
    if len(c) > 1:
        keep = np.append(True, is_letter[1:] | is_letter[:-1] | (doc[1:] != doc[:-1]))
        c, doc = c[keep], doc[keep]
    h, out, who = np.zeros(len(c), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * U(0x9E3779B97F4A7C15) + c[n - 1 :] + U(n)
        if n in ORDERS:
            same = doc[: len(h)] == doc[n - 1 :]
            g = h[same]
            out.append((((g ^ (g >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS)).astype(np.int32))
            who.append(doc[: len(h)][same])
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(out), np.concatenate(who)


def distinct(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(doc.astype(np.int64) << BITS | bucket)
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    return key & ((1 << BITS) - 1), key >> BITS


class Model:
    def __init__(self, weight: np.ndarray, intercept: float):
        """weight: of each bucket, log-count ratio and coefficient multiplied."""
        self.weight, self.intercept = weight, intercept

    def __getstate__(self):
        at = np.flatnonzero(self.weight)
        return at.astype(np.int32), self.weight[at], self.intercept

    def __setstate__(self, state):
        at, values, self.intercept = state
        self.weight = np.zeros(1 << BITS, np.float32)
        self.weight[at] = values

    def score(self, texts: list[str | None]) -> np.ndarray:
        b, doc = grams(texts)
        some = self.weight[b] != 0
        b, doc = distinct(b[some], doc[some])
        z = self.intercept + np.bincount(doc, self.weight[b], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def regress(rows: np.ndarray, cols: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse rows (value of a column: its r) by Adam on the full gradient."""
    w, b = np.full(len(r), 0.3), 0.0
    cost = 1 / len(y)
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, (w * r)[cols], len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * cost
        g = np.append(np.bincount(cols, e[rows], len(r)) * r + l2 * w / len(r), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        s = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - s[:-1], b - s[-1]
    return w * r, b


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, telling: float = TELLING) -> Model:
    # The labels are at most max_rows ids and small integers, so they can go to every task.
    some = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, target, max_rows)), "doc_id")
    some = materialize(some.repartition("doc_id", "text"))  # out of the scan's many tasks, which have a few rows each
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for x in steps(batches, size=_STEP):
            y = column(x, "label").to_numpy() > 0
            b, doc = distinct(*grams(column(x, "text").to_pylist()))
            for k in (0, 1):
                total[k] += np.bincount(b[y[doc] == k], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(total[0] + total[1])
        ends = np.searchsorted(at, np.arange(0, (1 << BITS) + 1, 1 << RANGE_BITS))
        own = [(k, at[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        cols = [[k for k, _ in own], *([planes(x[i]) for _, i in own] for x in (np.arange(1 << BITS), total[1], total[0]))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 3))], ["range", "bucket", "pos", "neg"])

    size = some.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    n_pos, n_neg = size[0], size[1]
    if not n_pos or not n_neg:
        p = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))

    def select(t: pa.Table) -> pa.Table:
        bucket, pos, neg = (np.concatenate([from_planes(x) for x in t[c].to_pylist()]) for c in ("bucket", "pos", "neg"))
        low = int(bucket.min())
        pos, neg = (np.bincount(bucket - low, x) for x in (pos, neg))
        r = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
        at = np.flatnonzero(np.abs(r) * np.abs(pos / n_pos - neg / n_neg) >= telling)
        return pa.table([pa.array((at + low).astype(np.int32)), pa.array(r[at])], ["bucket", "r"])

    sums = some.select("text", "label").mapInArrow(count, "range int, bucket binary, pos binary, neg binary")
    best = sums.groupBy("range").applyInArrow(select, "bucket int, r double").toArrow().sort_by([("bucket", "ascending")])
    chosen, r = best["bucket"].to_numpy(), best["r"].to_numpy()
    index = spark.sparkContext.broadcast(chosen)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[index.value] = np.arange(len(index.value))
        for x in steps(batches, size=_STEP):
            b, doc = grams(column(x, "text").to_pylist())
            hit = place[b] >= 0
            b, doc = distinct(b[hit], doc[hit])
            offs = np.searchsorted(doc, np.arange(x.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([column(x, "doc_id"), column(x, "label"), pa.ListArray.from_arrays(pa.array(offs), pa.array(place[b]))], ["doc_id", "label", "cols"])

    rows = some.mapInArrow(project, "doc_id long, label int, cols array<int>").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = rows["cols"].combine_chunks() if isinstance(rows["cols"], pa.ChunkedArray) else rows["cols"]
    sizes = np.diff(np.asarray(lists.offsets))
    y = rows["label"].to_numpy().astype(float)
    coef, intercept = regress(np.repeat(np.arange(len(y)), sizes), np.asarray(lists.flatten()), r, y)
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = coef
    return Model(weight, float(intercept))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in steps(batches, size=_STEP):
            s = shared.value.score(column(x, "text").to_pylist())
            yield pa.record_batch([column(x, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double, predicted int")
