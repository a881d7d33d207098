"""Language ID: multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities (buckets x languages) goes to the executors; texts are scored a
batch at a time as sparse rows in numpy. It is fitted on a bounded sample of documents of each
language; the prior counts all of them.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing was learned;
a null language teaches nothing; equal posteriors go to the first language in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, codepoints, column, fold, letter_table, steps

ORDERS = (1, 2, 3, 4)
BITS = 16
#: Documents of each language that the model is fitted on, on average; chosen by a hash of the id.
DOCS_PER_LANGUAGE = 4000
SMOOTHING = 0.5
_STEP = 1 << 20


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text index) of every n-gram, and whether each text has a letter. What is no letter counts as a space."""
    cp, offs = codepoints(texts)
    is_letter = letter_table()[cp]
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(is_letter, dtype=np.int64)])
    has = run[offs[1:]] > run[offs[:-1]]
    c = np.where(is_letter, cp, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offs))
    h, out, who = np.zeros(len(c), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * U(0x9E3779B97F4A7C15) + c[n - 1 :] + U(n)
        if n in ORDERS:
            same = doc[: len(h)] == doc[n - 1 :]
            g = h[same]
            out.append((((g ^ (g >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS)).astype(np.int64))
            who.append(doc[: len(h)][same])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32), has
    return np.concatenate(out), np.concatenate(who), has


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        """counts: languages x buckets; docs: documents of each language."""
        self.langs = langs
        p = counts + SMOOTHING
        self.logp = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32)) if langs else None
        self.prior = np.log(np.maximum(docs, 1) / max(1, docs.sum())) if langs else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        b, doc, has = buckets(texts)
        total = np.tile(self.prior, (n, 1))
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(doc, self.logp[:, k][b], n)
        best = total.argmax(1)
        post = np.exp(total - total.max(1, keepdims=True))
        score = np.where(has, post.max(1) / post.sum(1), 0.0)
        return [self.langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())], score


def teaching() -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2)


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    train = docs.where(teaching())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    chosen = train.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for x in steps(batches, size=_STEP):
            names = np.array(column(x, "lang").to_pylist(), object)
            b, doc, _ = buckets(column(x, "text").to_pylist())
            for k in set(names):
                total[k] = total.get(k, 0) + np.bincount(b[(names == k)[doc]], minlength=1 << BITS)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "bucket", "n"])

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << BITS))
    where = {k: i for i, k in enumerate(langs)}
    rows = np.array([where[k] for k in sums["lang"].to_pylist()], np.int64)
    counts[rows, sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return Model(langs, counts, np.array([sizes[k] for k in langs], float))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in steps(batches, size=_STEP):
            lang, score = shared.value.predict(column(x, "text").to_pylist())
            yield pa.record_batch([column(x, "doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, lang_pred string, score double")
