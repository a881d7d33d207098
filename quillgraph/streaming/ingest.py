"""Streaming ingestion: batches of a file source embedded, resolved by id and merged into versions of a table.

An extension: idempotent, as a batch is merged by key and notes its number in the version that it makes; a
replayed batch changes nothing. Only the buckets that a batch falls in are written (`snapshots`), and
a version counts once its manifest is there: whatever a failure leaves behind, the last version stays in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillgraph.functions.vector import mock_embedding
from quillgraph.operators import state
from quillgraph.snapshots import Store

NODE = "id string, label string, name string, props map<string,string>"


def current(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The nodes of the newest version, or of a given one; empty before the first batch."""
    store = Store(spark, folder)
    m = store.manifest(version)
    return store.read("nodes", version) if "nodes" in m.tables else spark.createDataFrame([], NODE)


def commit(batch: DataFrame, number: int, folder: str) -> None:
    """Merge a batch, unless a version says that it was."""
    spark = batch.sparkSession
    tx = Store(spark, folder).begin()
    if tx.tags.get("batch", -1) >= number:
        return
    tx.create("nodes", StructType.fromDDL(NODE), ["id"])
    tx.change("nodes", batch.select("id", "label", "name", "props").where("id is not null"), state.upsert_nodes)
    tx.tag("batch", number)
    tx.commit()


def ingest(spark: SparkSession, source: str, folder: str, schema: StructType | str, to_nodes, **trigger) -> StreamingQuery:
    """Start merging the rows of JSON files below source, turned to nodes by to_nodes, into the snapshots of folder."""
    stream = to_nodes(spark.readStream.schema(schema).json(source))
    write = stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(lambda df, k: commit(df, k, folder))
    return write.trigger(**(trigger or {"availableNow": True})).start()


def embed(nodes: DataFrame, dims: int = 64) -> DataFrame:
    return nodes.withColumn("embedding", mock_embedding(F.col("name"), dims))


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value); on a stream, rows later than `late` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
