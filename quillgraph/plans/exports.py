"""Reports and graph documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.lineage import scratch
from quillgraph.operators import ddl
from quillgraph.operators import export as O
from quillgraph.sources import tables as T

from .registry import query, with_views

_ALL = "own AS (SELECT * FROM nodes), links AS (SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)), deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY 1)"
SQL = with_views("nodes", "edges", also=_ALL)


def whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return T.nodes(spark, d), T.edges(spark, d)


@query(
    "b1_inventory_csv",
    with_views("entities", "statements") + """SELECT d.doc_id AS content_id, CASE WHEN length(d.text) > 100 THEN substr(d.text, 1, 97) || '...' ELSE d.text END AS note, e.name AS entity, s.predicate, coalesce(o.name, s.object) AS object
    FROM documents d LEFT JOIN entities e ON e.content_id = d.doc_id AND e.kind = 'Supplier' LEFT JOIN statements s ON s.entity_id = e.id LEFT JOIN entities o ON o.id = s.object_entity_id""",
)
def b1(spark: SparkSession, d: str) -> DataFrame:
    c = T.contents(spark, d).select(F.col("id").alias("content_id"), X.truncate(F.col("note")).alias("note"))
    e = T.entities(spark, d)
    own = e.where("kind = 'Supplier'").select("content_id", F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    s = T.statements(spark, d).select("entity_id", "predicate", "object", "object_entity_id")
    o = e.select(F.col("id").alias("object_entity_id"), F.col("name").alias("object_name"))
    j = own.join(s, "entity_id", "left").join(o, "object_entity_id", "left")
    return c.join(j, "content_id", "left").select("content_id", "note", "entity", "predicate", F.coalesce("object_name", "object").alias("object"))


@query("b3_graph_json", SQL + "SELECT count(*) AS n_lines, count(*) FILTER (WHERE k = 'n') AS n_nodes FROM (SELECT 'n' AS k FROM own UNION ALL SELECT 'l' FROM links)")
def b3(spark: SparkSession, d: str) -> DataFrame:
    x = O.export(*whole(spark, d), "json")
    return x.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.get_json_object("line", "$.node.id").isNotNull()).alias("n_nodes"))


@query("b3_graph_document", SQL + "SELECT (SELECT count(*) FROM own)::INTEGER AS n_nodes, (SELECT count(*) FROM links)::INTEGER AS n_links")
def b3b(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and links of the one document, which is read back item by item."""
    doc = O.document(*O.graph(*whole(spark, d)))
    x = F.from_json(F.ltrim(F.col("line"), F.lit(",")), "id string, source string")
    n_nodes, n_links = (F.count_if((F.col("part") == part) & F.col(f"x.{k}").isNotNull()).cast("int") for part, k in ((1, "id"), (3, "source")))
    return doc.withColumn("x", x).agg(n_nodes.alias("n_nodes"), n_links.alias("n_links"))


@query("b4_graphml", SQL + ", num AS (SELECT *, row_number() OVER (ORDER BY src || '|' || dst || '|' || type) - 1 AS i FROM links) SELECT '<edge id=\"e' || i || '\" source=\"' || src || '\" target=\"' || dst || '\"><data key=\"type\">' || type || '</data></edge>' AS line FROM num")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return O.export(*whole(spark, d), "graphml").where("part = 3").select("line")


@query("b5_gexf", SQL + "SELECT '<node id=\"' || s.id || '\" label=\"' || name || '\"><attvalues><attvalue for=\"0\" value=\"' || label || '\"/><attvalue for=\"1\" value=\"' || coalesce(n, 0) || '\"/></attvalues></node>' AS line FROM own s LEFT JOIN deg ON deg.id = s.id")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return O.export(*whole(spark, d), "gexf").where("part = 1").select("line")


@query("b6_cytoscape", SQL + "SELECT src AS source, dst AS target, type AS label FROM links")
def b6(spark: SparkSession, d: str) -> DataFrame:
    x = O.export(*whole(spark, d), "cytoscape").where("part = 3")
    return x.select(*[F.get_json_object("line", f"$.data.{k}").alias(k) for k in ("source", "target", "label")])


_IDX = SQL + ", idx AS (SELECT s.id, label, coalesce(n, 0) AS n, row_number() OVER (ORDER BY s.id) - 1 AS i FROM own s LEFT JOIN deg ON deg.id = s.id) "


@query("b7_d3_nodes", _IDX + "SELECT i AS index, id, label AS class, n AS connections FROM idx")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return O.to_d3(*O.graph(*whole(spark, d)))[0].drop("name")


@query("b7_d3_links", _IDX + "SELECT a.i AS source_index, b.i AS target_index, type FROM links JOIN idx a ON a.id = src JOIN idx b ON b.id = dst")
def b7b(spark: SparkSession, d: str) -> DataFrame:
    return O.to_d3(*O.graph(*whole(spark, d)))[1]


@query("b8_format_dispatch", SQL + "SELECT 'json' AS kind, (SELECT count(*) FROM own) + (SELECT count(*) FROM links) AS n UNION ALL SELECT 'graphml', (SELECT count(*) FROM own) + (SELECT count(*) FROM links) + 9 UNION ALL SELECT 'unknown', (SELECT count(*) FROM own) + (SELECT count(*) FROM links)")
def b8(spark: SparkSession, d: str) -> DataFrame:
    out = [O.export(*whole(spark, d), k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("json", "graphml", "unknown")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("b20_check_expressions", "SELECT count(*) AS n FROM customer WHERE c_name IS NULL OR c_acctbal IS NULL")
def b20(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of the schema as checks: required columns that are null."""
    return T.table(spark, d, "customer").agg(F.count_if(F.col("c_name").isNull() | F.col("c_acctbal").isNull()).alias("n"))


#: A schema over the graph's labels: what is required, unique, typed, enumerated and indexed.
SCHEMA = {
    "Part": {"properties": [{"name": "p_type", "type": "integer"}, {"name": "p_brand", "type": "string", "required": True, "unique": True}]},
    "Customer": {"properties": [{"name": "c_name", "unique": True}, {"name": "c_mktsegment", "enum": ["BUILDING", "MACHINERY"]}, {"name": "email", "required": True}]},
    "indexes": [{"label": "Part", "properties": ["p_type", "p_brand"]}],
}


@query(
    "b20_violations",
    """SELECT 'Part_' || p_partkey AS id, 'p_brand' AS property, 'not_unique' AS problem, p_brand AS value FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'Part_' || p_partkey, 'p_type', 'wrong_type', p_type FROM part UNION ALL SELECT 'Customer_' || c_custkey, 'email', 'missing', NULL FROM customer
    UNION ALL SELECT 'Customer_' || c_custkey, 'c_mktsegment', 'not_allowed', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'Customer_' || c_custkey, 'c_name', 'not_unique', c_name FROM customer WHERE c_name IN (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)""",
)
def b20v(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of a declared schema, over all nodes."""
    return ddl.violations(T.nodes(spark, d), ddl.declared(SCHEMA)[0]).select("id", "property", "problem", "value")


@query("b20_index_lookup", "SELECT 'Part_' || p_partkey AS id, p_name AS name, 'brand' AS by FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION ALL SELECT 'Part_' || p_partkey, p_name, 'type, brand' FROM part WHERE p_type = (SELECT max(p_type) FROM part) AND p_brand = (SELECT min(p_brand) FROM part)")
def b20x(spark: SparkSession, d: str) -> DataFrame:
    """The indexes of the schema written as sorted tables, and looked up: by one property, and by a composite one."""
    indexes, folder = ddl.declared(SCHEMA)[1], scratch(spark)
    ddl.build(T.nodes(spark, d), indexes, folder)
    ends = T.table(spark, d, "part").agg(F.min("p_brand").alias("brand"), F.max("p_type").alias("type")).first()
    one = ddl.lookup(spark, indexes, folder, "Part", p_brand=ends["brand"]).withColumn("by", F.lit("brand"))
    return one.unionByName(ddl.lookup(spark, indexes, folder, "Part", p_type=ends["type"], p_brand=ends["brand"]).withColumn("by", F.lit("type, brand")))


@query("b22_seed_references", "SELECT 'Nation_' || n_nationkey AS src, 'Region_' || n_regionkey AS dst, 'region' AS type FROM nation")
def b22(spark: SparkSession, d: str) -> DataFrame:
    """Objects with nested references become typed edges."""
    refs = F.array(F.struct(F.lit("region").alias("name"), F.array(F.concat(F.lit("Region_"), "n_regionkey")).alias("to")))
    o = T.table(spark, d, "nation").select(F.concat(F.lit("Nation_"), "n_nationkey").alias("src"), F.explode(refs).alias("r"))
    return o.select("src", F.explode("r.to").alias("dst"), F.col("r.name").alias("type"))
