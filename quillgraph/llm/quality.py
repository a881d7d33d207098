"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Defined cases: a null or empty text has all-zero statistics and is scored like any other; labels
that are null are no labels; several label rows of one document count once (the larger label);
an empty label set gives the constant score 0.5. Columns beside the id and the text are ignored.
Repeated rows of a labelled document are one training row each; texts alike have scores alike,
whatever their id; a text of any length is scored as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import buffers, column, filter_by_text, fold, steps

#: Labelled rows that the trees are fitted on at most: those of the smallest hash of the id.
MAX_TRAIN_ROWS = 20_000

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "punct", "symbol", "bar", "non_ascii", "line_bytes",
    "distinct_words", "distinct_pairs", "top_word", "top3_words", "longest_word", "distinct_lines", "same_next",
]

_CLASSES = np.zeros((9, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [32, 9, 13]] = True
_CLASSES[3, 10] = True
_CLASSES[4, [ord(c) for c in ".,;:?'\"()-"]] = True
_CLASSES[5, [ord(c) for c in "#$%&*@^~=+<>{}[]\\/_!"]] = True
_CLASSES[6, ord("|")] = True
_CLASSES[7, 128:192] = True  # continuation bytes
_CLASSES[8, 192:] = True


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = buffers(col)
    n, size = len(offs) - 1, np.diff(offs)
    x = np.zeros((n, len(FEATURES)))
    share = np.zeros((n, len(_CLASSES)))
    for k, members in enumerate(_CLASSES):
        run = np.concatenate([np.zeros(1, np.int64), np.cumsum(members[data], dtype=np.int64)])
        share[:, k] = run[offs[1:]] - run[offs[:-1]]
    share /= np.maximum(size, 1)[:, None]
    raw, o = data.tobytes(), offs.tolist()
    for i in range(n):
        text = raw[o[i] : o[i + 1]]
        w = text.split()
        if not w:
            continue
        c = Counter(w)
        top = sorted(c.values(), reverse=True)[:3]
        lines = [s for s in text.split(b"\n") if s]
        m = len(w)
        x[i, 1] = m
        x[i, 2] = sum(map(len, w)) / m
        x[i, 11] = len(text) / max(1, len(lines))
        x[i, 12] = len(c) / m
        x[i, 13] = len(set(zip(w, w[1:]))) / max(1, m - 1)
        x[i, 14] = top[0] / m
        x[i, 15] = sum(top) / m
        x[i, 16] = max(map(len, c))
        x[i, 17] = len(set(lines)) / max(1, len(lines))
        x[i, 18] = sum(a == b for a, b in zip(w, w[1:])) / m
    x[:, 0], x[:, 1] = np.log1p(size), np.log1p(x[:, 1])
    x[:, 3:11] = share[:, [0, 1, 2, 3, 4, 5, 6, 8]]
    x[:, 11] = np.log1p(x[:, 11])
    return x


def labelled(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most `bound` training labels (doc_id, label): none of the held-out quarter, chosen by a hash of the id."""
    return (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2))
        .groupBy("doc_id")
        .agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id")), "doc_id")
        .limit(bound)
    )


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> gbt.FlatTrees:
    # The labels are at most max_rows ids and small integers, so they can go to every task.
    some = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, target, max_rows)), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x = features(column(b, "text"))
            yield pa.record_batch([column(b, "doc_id"), column(b, "label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = some.mapInArrow(extract, "doc_id long, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    y = rows["label"].to_numpy().astype(float)
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    return gbt.train(x, y)


def score(docs: DataFrame, model: gbt.FlatTrees, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            s = shared.value.score(features(column(b, "text")))
            yield pa.record_batch([column(b, "doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: gbt.FlatTrees, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_by_text(docs, lambda texts: shared.value.score(features(texts)) >= threshold)
