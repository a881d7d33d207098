"""Declared schemas: violations as rows, indexes that prune."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ddl

SCHEMA = {
    "version": "1",
    "User": {"properties": [{"name": "email", "type": "email", "required": True, "unique": True}, {"name": "age", "type": "integer"}, {"name": "level", "enum": ["low", "high"], "indexed": True}]},
    "Big Thing": {"properties": [{"name": "code", "indexed": True}, {"name": "code", "indexed": True}]},
    "indexes": [{"label": "User", "properties": ["level", "age"]}],
}
ROWS = [
    ("1", "User", "a", {"email": "a@x.org", "age": "3", "level": "low"}),
    ("2", "User", "b", {"email": "a@x.org", "age": "old", "level": "mid"}),
    ("3", "User", "c", {"email": " ", "age": None}),
    ("4", "User", "d", None),
    ("5", "Other", "e", {"email": "a@x.org"}),
    ("5", "Other", "e", {"email": "a@x.org"}),
    ("6", "User", "f", {"email": "f@x.org", "age": "4", "level": "low"}),
    ("6", "User", "f", {"email": "f@x.org", "age": "4", "level": "low"}),  # a repeated row is no second node
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, "id string, label string, name string, props map<string,string>")


def test_violations(spark, nodes):
    constraints, indexes = ddl.declared(SCHEMA)
    assert [i.name for i in indexes] == ["user_email_idx", "user_level_idx", "big_thing_code_idx", "user_level_age_idx"]
    got = sorted((r["id"], r["property"], r["problem"], r["value"]) for r in ddl.violations(nodes, constraints).select("id", "property", "problem", "value").collect())
    assert got == [("1", "email", "not_unique", "a@x.org"), ("2", "age", "wrong_type", "old"), ("2", "email", "not_unique", "a@x.org"), ("2", "level", "not_allowed", "mid"), ("3", "email", "missing", None), ("4", "email", "missing", None)]
    assert ddl.violations(nodes, []).isEmpty() and ddl.violations(nodes.where("false"), constraints).isEmpty()


def test_indexes_prune(spark, nodes, tmp_path):
    indexes = ddl.declared(SCHEMA)[1]
    ddl.build(nodes, indexes, str(tmp_path))
    find = lambda **p: sorted(r["id"] for r in ddl.lookup(spark, indexes, str(tmp_path), "User", **p).distinct().collect())
    assert find(level="low") == ["1", "6"] and find(level="low", age="4") == ["6"] and find(email="nobody") == []
    plan = ddl.lookup(spark, indexes, str(tmp_path), "User", level="low", age="4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan and "EqualTo(p0,low)" in plan and "EqualTo(p1,4)" in plan
    with pytest.raises(KeyError):
        ddl.lookup(spark, indexes, str(tmp_path), "User", age="4")
    ddl.drop(spark, indexes, str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    many = spark.range(20000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("User").alias("label"), F.lit("x").alias("name"), F.create_map(F.lit("level"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("props"))
    index = [ddl.Index("User", ("level",))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ddl.build(many, index, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = ddl.lookup(spark, index, str(tmp_path), "User", level="000123")
    assert rows.count() == 1
    files = list(tmp_path.rglob("*.parquet"))
    assert len(files) >= 4  # dealt by ranges: the value lies in the range of one of them
    import pyarrow.parquet as pq

    ranges = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in files]
    assert sum(s.min <= "000123" <= s.max for s in ranges) == 1
