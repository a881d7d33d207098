"""The graph model over the star-schema tables: entities, statements, contents, nodes and edges.

Entities are customers, suppliers, parts and nations, in ranges of ids of their own. Statements
come from orders (relationships to parts), customers (an attribute, and a location that is stated
as a literal but has an object entity) and suppliers. Every builder is one lazy projection or
union; filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER, PART, NATION = 1_000_000_000, 2_000_000_000, 3_000_000_000
STATUSES = ("pending", "verified", "rejected", "merged")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("note"), "lang", "source")


def _entity(ident: Column, kind: str, name: str) -> list[Column]:
    return [
        ident.cast("long").alias("id"),
        F.lit(kind).alias("kind"),
        F.col(name).alias("name"),
        F.pmod(ident, F.lit(1000)).cast("long").alias("content_id"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.pmod(ident, F.lit(4)) + 1).cast("int")).alias("verification_status"),
    ]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(*_entity(F.col("c_custkey"), "Customer", "c_name"))
    s = table(spark, sf_dir, "supplier").select(*_entity(F.col("s_suppkey") + SUPPLIER, "Supplier", "s_name"))
    p = table(spark, sf_dir, "part").select(*_entity(F.col("p_partkey") + PART, "Part", "p_name"))
    n = table(spark, sf_dir, "nation").select(*_entity(F.col("n_nationkey") + F.lit(NATION), "Nation", "n_name"))
    return c.unionByName(s).unionByName(p).unionByName(n)


ENTITIES_SQL = f"""
entity_base AS (
  SELECT c_custkey::BIGINT AS id, 'Customer' AS kind, c_name AS name FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 'Supplier', s_name FROM supplier
  UNION ALL SELECT p_partkey + {PART}, 'Part', p_name FROM part
  UNION ALL SELECT n_nationkey + {NATION}, 'Nation', n_name FROM nation),
entities AS (SELECT *, (id % 1000)::BIGINT AS content_id,
  CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' WHEN 2 THEN 'rejected' ELSE 'merged' END AS verification_status FROM entity_base)"""


def hundredths(c: Column) -> Column:
    """A double, not negative, to two places, as DuckDB rounds it: by its hundredfold as a double, not (like Spark's round) by its shortest decimals."""
    x = c * 100
    low = F.floor(x)
    return (low + F.when(x - low >= 0.5, 1).otherwise(0)) / 100.0


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 4).alias("id"),
        F.col("o_custkey").alias("entity_id"),
        (F.pmod(F.col("o_orderkey"), F.lit(200)) + PART).alias("object_entity_id"),
        F.concat(F.lit("ordered_"), "o_orderstatus").alias("predicate"),
        F.lit(None).cast("string").alias("object"),
        F.lit("entity").alias("object_type"),
        F.least(F.lit(1.0), hundredths(F.col("o_totalprice") / 500000)).alias("confidence"),
    )
    c = table(spark, sf_dir, "customer")
    seg = c.select((F.col("c_custkey") * 4 + 1).alias("id"), F.col("c_custkey").alias("entity_id"), F.lit(None).cast("long").alias("object_entity_id"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"), F.lit("literal").alias("object_type"), F.lit(0.7).alias("confidence"))
    loc = c.join(nation, c["c_nationkey"] == nation["nk"]).select((F.col("c_custkey") * 4 + 2).alias("id"), F.col("c_custkey").alias("entity_id"), (F.col("nk") + F.lit(NATION)).cast("long").alias("object_entity_id"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit("literal").alias("object_type"), F.lit(0.9).alias("confidence"))
    s = table(spark, sf_dir, "supplier")
    sup = s.join(nation, s["s_nationkey"] == nation["nk"]).select((F.col("s_suppkey") * 4 + 3).alias("id"), (F.col("s_suppkey") + SUPPLIER).alias("entity_id"), (F.col("nk") + F.lit(NATION)).cast("long").alias("object_entity_id"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit("entity").alias("object_type"), F.lit(1.0).alias("confidence"))
    out = o.unionByName(seg).unionByName(loc).unionByName(sup)
    text = F.concat_ws(" ", F.concat(F.lit("E"), F.col("entity_id")), F.lit("has"), "predicate", F.coalesce("object", F.concat(F.lit("E"), F.col("object_entity_id"))))
    return out.withColumn("text", text).withColumn("content_id", F.pmod(F.col("id"), F.lit(1000)))


STATEMENTS_SQL = f"""
statement_base AS (
  SELECT o_orderkey * 4 AS id, o_custkey AS entity_id, o_orderkey % 200 + {PART} AS object_entity_id, 'ordered_' || o_orderstatus AS predicate,
         NULL::VARCHAR AS object, 'entity' AS object_type, least(1.0::DOUBLE, round(o_totalprice / 500000, 2)) AS confidence FROM orders
  UNION ALL SELECT c_custkey * 4 + 1, c_custkey, NULL, 'segment', c_mktsegment, 'literal', 0.7 FROM customer
  UNION ALL SELECT c_custkey * 4 + 2, c_custkey, n_nationkey + {NATION}, 'located_in', n_name, 'literal', 0.9 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey * 4 + 3, s_suppkey + {SUPPLIER}, n_nationkey + {NATION}, 'located_in', n_name, 'entity', 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
statements AS (SELECT *, concat_ws(' ', 'E' || entity_id, 'has', predicate, coalesce(object, 'E' || object_entity_id)) AS text, id % 1000 AS content_id FROM statement_base)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, name, props (map of strings)."""

    def part(t: str, label: str, key: str, name: str, *props: str) -> DataFrame:
        m = F.create_map(*[x for p in props for x in (F.lit(p), F.col(p).cast("string"))])
        return table(spark, sf_dir, t).select(F.concat(F.lit(label + "_"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), m.alias("props"))

    parts = [
        part("region", "Region", "r_regionkey", "r_name", "r_name"),
        part("nation", "Nation", "n_nationkey", "n_name", "n_name"),
        part("customer", "Customer", "c_custkey", "c_name", "c_name", "c_mktsegment"),
        part("supplier", "Supplier", "s_suppkey", "s_name", "s_name"),
        part("part", "Part", "p_partkey", "p_name", "p_brand", "p_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """
nodes AS (
  SELECT 'Region_' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'Nation_' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Customer_' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Part_' || p_partkey, 'Part', p_name FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, once for each pair and type."""

    def part(t: str, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, t).select(F.concat(F.lit(a + "_"), F.col(ka)).alias("src"), F.concat(F.lit(b + "_"), F.col(kb)).alias("dst"), F.lit(kind).alias("type"))

    supplied = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = part("customer", "Customer", "c_custkey", "Nation", "c_nationkey", "LOCATED_IN")
    out = out.unionByName(part("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", "LOCATED_IN"))
    out = out.unionByName(part("nation", "Nation", "n_nationkey", "Region", "n_regionkey", "PART_OF"))
    return out.unionByName(supplied.select(F.concat(F.lit("Part_"), "l_partkey").alias("src"), F.concat(F.lit("Supplier_"), "l_suppkey").alias("dst"), F.lit("SUPPLIED_BY").alias("type")))


EDGES_SQL = """
edges AS (
  SELECT 'Customer_' || c_custkey AS src, 'Nation_' || c_nationkey AS dst, 'LOCATED_IN' AS type FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Nation_' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'Nation_' || n_nationkey, 'Region_' || n_regionkey, 'PART_OF' FROM nation
  UNION ALL SELECT DISTINCT 'Part_' || l_partkey, 'Supplier_' || l_suppkey, 'SUPPLIED_BY' FROM lineitem)"""
