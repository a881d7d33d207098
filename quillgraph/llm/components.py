"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Parts that the edges of one node are dealt to.
SALT = 16


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with m of their u; the edges of one u are dealt to SALT tasks, as a star has all of them."""
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge that is not the smallest of its component; edges: (u, v), long.

    Every round is written out, so a lost executor costs one round at most. Components of any shape
    need O(log^2) rounds; stars to their smallest node need one.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_low(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_low(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        last, e = e, materialize(small.where("u <> v").distinct())
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
