"""Where a deployment's models plug in, with deterministic offline stand-ins.

Nothing here calls out: an embedder, an arbiter or a chat model is a Python callable that the caller
brings; without one the rules of this package answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import matchers as M
from quillgraph.functions.vector import mock_embedding

Embedder = Callable[[list[str]], list[list[float] | None]]


def embedding(text: Column, dims: int = 1536, embedder: Embedder | None = None, batch: int = 100) -> Column:
    """Vectors of texts; null for blank ones and where the embedder fails. Texts go to it `batch` at a time."""
    if embedder is None:
        return mock_embedding(text, dims)

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = [None] * len(s)
            full = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            for a in range(0, len(full), batch):
                own = full[a : a + batch]
                try:
                    got = embedder([s.iloc[i] for i in own])
                except Exception:  # a failing service must not fail the job; these rows stay without a vector
                    continue
                for i, v in zip(own, got):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return embed(text)


def arbitrate(candidates: DataFrame, node_type: str, least: float = M.AUTO_MERGE) -> DataFrame:
    """new_id, match_id of candidates (new_id, id, a, b: property maps): the most certain one, or null for no match.

    The offline arbiter takes the confidence of the type's rules; ties go to the lowest id.
    """
    a, b = F.col("a"), F.col("b")
    x = candidates.withColumns({"a": M.prepare(a), "b": M.prepare(b)}).withColumn("rules", M.fired(node_type, a, b))
    x = x.withColumn("score", M.confidence(node_type, a, b, F.col("rules")))
    best = x.groupBy("new_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m"))
    return best.select("new_id", F.when(-F.col("m.s") >= least, F.col("m.id")).alias("match_id"))


def relation(a: Column, b: Column, score: Column) -> Column:
    """struct<kind, confidence>: duplicate, component (b is part of a), reverse_component or none; confidence within [0, 1].

    Offline, a name that continues another one with a part's name makes it a component.
    """
    x, y = F.lower(F.trim(a["name"])), F.lower(F.trim(b["name"]))
    kind = F.when(score >= M.AUTO_MERGE, "duplicate").when(F.startswith(y, F.concat(x, F.lit(" "))), "component").when(F.startswith(x, F.concat(y, F.lit(" "))), "reverse_component").otherwise("none")
    return F.struct(kind.alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def with_retry(call: Callable[[str], str], tries: int = 3, wait: float = 1.0, again: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> Callable[[str], str]:
    """A chat model that is asked again, after longer and longer waits, when it is busy."""

    def ask(prompt: str) -> str:
        for k in range(tries):
            try:
                return call(prompt)
            except again:
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError("tries must be positive")

    return ask
