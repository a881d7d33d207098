"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; a temporary folder stands in where the setting is absent (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillgraph/{uuid.uuid4().hex}"


#: For what is written within a query: the driver keeps no long description of its plan, and Spark removes its shuffle files at its end.
_WITHIN = {"spark.sql.maxPlanStringLength": "20000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def cut(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read back: later plans start here, and lost executors cost no recomputation."""
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession)
    before = {k: spark.conf.get(k) for k in _WITHIN}
    try:
        for k, v in _WITHIN.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(path)
