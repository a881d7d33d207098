"""Streaming queries, run to the end of their source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources import tables as T
from quillgraph.streaming import ingest

from .registry import query

_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query("s1_windowed_batch", _SQL)
def s1(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(T.table(spark, d, "events"))


@query("s2_windowed_stream", _SQL)
def s2(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream over the table's files, in complete mode (nothing is late in one micro-batch)."""
    schema = T.table(spark, d, "events").schema
    name = "quill_" + uuid.uuid4().hex
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")
    q = ingest.windowed(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
