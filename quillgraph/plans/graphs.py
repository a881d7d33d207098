"""Traversal, ego networks and degree statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import taxonomy
from quillgraph.operators import graph as G
from quillgraph.sources import tables as T

from .registry import query, with_views

#: The classes of the schema dump.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

D, ND = with_views("edges"), with_views("nodes", "edges")
_STEPS = "steps AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
_HOPS = _STEPS + """, h1 AS (SELECT 'Region_1' AS start, b AS node FROM steps WHERE a = 'Region_1'),
 h2 AS (SELECT DISTINCT 'Region_1' AS start, s.b AS node FROM h1 JOIN steps s ON s.a = h1.node WHERE s.b <> 'Region_1' AND s.b NOT IN (SELECT node FROM h1)),
 hops AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)"""


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Region_1",)], "id string")


@query("o1_connected", with_views("edges", also=_HOPS) + "SELECT node, hop FROM hops")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return G.hops(T.edges(spark, d), _start(spark), 2).select("node", "hop")


@query("o1_many_starts", with_views("edges", also=_STEPS) + """, starts AS (SELECT 'Nation_' || n_nationkey AS start FROM nation), h1 AS (SELECT DISTINCT start, b AS node FROM starts JOIN steps ON a = start),
 h2 AS (SELECT DISTINCT start, s.b AS node FROM h1 JOIN steps s ON s.a = h1.node WHERE s.b <> start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = h1.start AND x.node = s.b))
 SELECT start, node, 1 AS hop FROM h1 UNION ALL SELECT start, node, 2 FROM h2""")
def o1m(spark: SparkSession, d: str) -> DataFrame:
    """Two hops around every nation at once; nations are hubs, whose neighbours are dealt to several tasks."""
    return G.hops(T.edges(spark, d), T.table(spark, d, "nation").select(F.concat(F.lit("Nation_"), "n_nationkey").alias("id")), 2).select("start", "node", "hop")


@query("o1_reach_recursive", "WITH RECURSIVE" + D.removeprefix("WITH").rstrip() + """, up(node) AS (SELECT dst FROM edges WHERE src = 'Supplier_3' AND type <> 'SUPPLIED_BY'
 UNION SELECT e.dst FROM up JOIN edges e ON e.src = up.node AND e.type <> 'SUPPLIED_BY') SELECT node FROM up""")
def o1r(spark: SparkSession, d: str) -> DataFrame:
    """Directed reach of one node, however far, on cycles too."""
    up = T.edges(spark, d).where("type <> 'SUPPLIED_BY'")
    return G.reach(up, spark.createDataFrame([("Supplier_3",)], "id string")).select("node")


@query("o2_ego_nodes", with_views("edges", also=_HOPS) + "SELECT node, CASE hop WHEN 1 THEN 'entity' ELSE 'extended' END AS \"group\" FROM hops UNION ALL SELECT 'Region_1', 'focus'")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return G.ego_network(T.edges(spark, d), _start(spark), 2)[0].select("node", "group")


@query("o2_ego_edges", with_views("edges", also=_HOPS) + ", own AS (SELECT node FROM hops UNION ALL SELECT 'Region_1') SELECT src, dst, type FROM edges WHERE src IN (SELECT node FROM own) AND dst IN (SELECT node FROM own)")
def o2b(spark: SparkSession, d: str) -> DataFrame:
    return G.ego_network(T.edges(spark, d), _start(spark), 2)[1].select("src", "dst", "type")


@query("o3_global_graph", with_views("nodes") + "SELECT label AS class, count(*) AS n, count(*) FILTER (WHERE coalesce(nullif(name, ''), 'Unnamed ' || label) LIKE 'Unnamed%') AS unnamed FROM nodes GROUP BY 1")
def o3(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("props")["title"], F.col("props")["content"], F.concat(F.lit("Unnamed "), "label"))
    return T.nodes(spark, d).select(F.col("label").alias("class"), name.alias("name")).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").startswith("Unnamed")).alias("unnamed"))


@query("o4_beacon_links", with_views("edges") + "SELECT DISTINCT src, dst, type FROM edges WHERE type = 'LOCATED_IN'")
def o4(spark: SparkSession, d: str) -> DataFrame:
    """References written as beacons (scheme://host/Class/id), parsed, and each link once."""
    e = T.edges(spark, d).where("type = 'LOCATED_IN'")
    b = e.select("src", F.concat(F.lit("ref://localhost/"), F.regexp_replace("dst", "_", "/")).alias("beacon"), "type")
    b = b.unionByName(b)
    end = F.split("beacon", "/")
    return b.select("src", F.concat_ws("_", F.element_at(end, -2), F.element_at(end, -1)).alias("dst"), "type").dropDuplicates()


@query("o5_neighbours", with_views("edges") + "SELECT 'out' AS way, dst AS node, type FROM edges WHERE src = 'Nation_3' UNION ALL SELECT 'in', src, type FROM edges WHERE dst = 'Nation_3'")
def o5(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d).where("src = 'Nation_3' or dst = 'Nation_3'")
    out = F.col("src") == "Nation_3"
    return e.select(F.when(out, "out").otherwise("in").alias("way"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("node"), "type")


@query("o6_find_relationships", with_views("edges") + "SELECT src, dst, type FROM edges WHERE src = 'Nation_3' AND dst LIKE 'Region_%'")
def o6(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).where((F.col("src") == "Nation_3") & F.col("dst").startswith("Region_")).select("src", "dst", "type")


@query("o7_nested_references", "SELECT s_suppkey, n_name AS nation, r_name AS region, count(DISTINCT l_partkey) AS n_parts FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3")
def o7(spark: SparkSession, d: str) -> DataFrame:
    e, n = T.edges(spark, d), T.nodes(spark, d).select("id", "name")
    parts = e.where("type = 'SUPPLIED_BY'").groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n_parts"))
    up = e.where("type = 'LOCATED_IN' and src like 'Supplier%'").select("src", F.col("dst").alias("nation_id"))
    top = e.where("type = 'PART_OF'").select(F.col("src").alias("nation_id"), F.col("dst").alias("region_id"))
    j = up.join(top, "nation_id").join(parts, "src", "left")
    j = j.join(n.withColumnsRenamed({"id": "nation_id", "name": "nation"}), "nation_id").join(n.withColumnsRenamed({"id": "region_id", "name": "region"}), "region_id")
    return j.select(F.split_part("src", F.lit("_"), F.lit(2)).cast("long").alias("s_suppkey"), "nation", "region", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@query("o8_relation_explorer", ND + "SELECT a.label AS class, e.type AS relation, b.label AS target_class, count(*) AS n, min(b.name) AS example FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2, 3")
def o8(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d)
    a, b = n.select(F.col("id").alias("src"), F.col("label").alias("class")), n.select(F.col("id").alias("dst"), F.col("label").alias("target_class"), "name")
    j = T.edges(spark, d).join(a, "src").join(b, "dst")
    return j.groupBy("class", F.col("type").alias("relation"), "target_class").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("example"))


@query("o9_inverse_edges", with_views("edges") + "SELECT src, dst, 'created_by' AS type FROM edges WHERE type = 'PART_OF' UNION ALL SELECT dst, src, 'created' FROM edges WHERE type = 'PART_OF'")
def o9(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d).where("type = 'PART_OF'").select("src", "dst", F.lit("created_by").alias("type"), F.lit("Nation").alias("src_class"))
    return G.with_inverses(e)


@query("o10_ancestors", "WITH t AS (SELECT 'Customer_' || c_custkey AS type, 'Nation_' || c_nationkey AS parent FROM customer UNION ALL SELECT 'Supplier_' || s_suppkey, 'Nation_' || s_nationkey FROM supplier UNION ALL SELECT 'Nation_' || n_nationkey, 'Region_' || n_regionkey FROM nation) SELECT DISTINCT type, parent AS ancestor FROM t UNION SELECT a.type, b.parent FROM t a JOIN t b ON a.parent = b.type")
def o10(spark: SparkSession, d: str) -> DataFrame:
    """The chain upwards of every node: what it is part of or located in, and what that is part of."""
    up = T.edges(spark, d).where(F.col("type").isin("LOCATED_IN", "PART_OF"))
    return G.ancestors(up.select(F.col("src").alias("type"), F.col("dst").alias("parent")))


@query("o11_schema_dump")
def o11(spark: SparkSession, d: str) -> DataFrame:
    """Every class with its properties, their types, the class that a property refers to (the one whose key it is), and how many objects have the property."""
    fields = [(t, f.name, f.dataType.simpleString()) for t in TABLES for f in T.table(spark, d, t).schema.fields]
    keys = {n.split("_", 1)[-1]: t for t, n, _ in fields if n.split("_", 1)[-1] in (f"{t}key", {"supplier": "suppkey", "customer": "custkey"}.get(t))}
    keys |= {n: t for t, n, _ in reversed(fields) if n in ("doc_id", "item_id", "page_id", "vec_id", "event_id", "conv_id")}
    out = []
    for t in TABLES:
        own = [(n, k, r if (r := keys.get(n, keys.get(n.split("_", 1)[-1]))) != t else None) for c, n, k in fields if c == t]
        counted = T.table(spark, d, t).agg(*[F.count(n).alias(n) for n, _, _ in own])
        rows = F.array(*[F.struct(F.lit(n).alias("property"), F.lit(k).alias("type"), F.lit(r).cast("string").alias("refers_to"), F.col(n).alias("n_objects")) for n, k, r in own])
        out.append(counted.select(F.lit(t).alias("class"), F.inline(rows)))
    return reduce(DataFrame.unionByName, out)


@query("k8_degree", with_views("edges") + "SELECT id, count(*) AS connections FROM (SELECT src AS id FROM (SELECT DISTINCT * FROM edges) UNION ALL SELECT dst FROM (SELECT DISTINCT * FROM edges)) GROUP BY 1")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(T.edges(spark, d))


@query("k11_hub_boost", with_views("edges") + ", deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT id, CASE WHEN id = 'Region_0' THEN greatest(n, (SELECT max(n) + 1 FROM deg)) ELSE n END AS connections FROM deg")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return G.hub_boost(G.degrees(T.edges(spark, d)), "Region_0")


@query(
    "k9_connection_stats",
    "WITH l AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l WHERE a <> b), p AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2) SELECT a AS name, sum(n)::BIGINT AS total, count(*)::INTEGER AS n_partners, arg_min(b, (-n, b)) AS first_partner FROM p GROUP BY 1",
)
def k9(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d).select("id", "name")
    e = T.edges(spark, d).where("type = 'PART_OF' or (type = 'LOCATED_IN' and src like 'Supplier%')")
    links = e.join(n.withColumnsRenamed({"id": "src", "name": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "name": "b"}), "dst")
    s = G.connection_stats(links)
    return s.select("name", "total", F.size("connections").alias("n_partners"), F.col("connections")[0]["name"].alias("first_partner"))


# ---- Taxonomy ------------------------------------------------------------------------------------


#: Labels of the graph as types of the taxonomy.
_TYPES = {"Customer": "Person", "Supplier": "Person", "Part": "Item", "Nation": "Location", "Region": "Location"}


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with their type in the taxonomy."""
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    return T.nodes(spark, d).select("id", kind[F.col("label")].alias("type"))


_TYPED = "typed AS (SELECT id, CASE label WHEN 'Customer' THEN 'Person' WHEN 'Supplier' THEN 'Person' WHEN 'Part' THEN 'Item' ELSE 'Location' END AS type FROM nodes)"


@query("p10_relations_of_type", with_views("nodes", also=_TYPED) + "SELECT id, relation FROM typed JOIN (VALUES ('Person', 'KNOWS'), ('Person', 'LIVES_AT'), ('Person', 'WORKS_AT'), ('Person', 'OWNS'), ('Person', 'PARTICIPATES_IN'), ('Location', 'CONTAINS'), ('Location', 'NEAR'), ('Location', 'HOSTS'), ('Item', 'OWNED_BY'), ('Item', 'LOCATED_AT'), ('Item', 'RELATED_TO'), ('Item', 'USED_IN'), ('Item', 'PART_OF'), ('Item', 'DOCUMENTED_BY')) t(type, relation) USING (type)")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """The relations that every node may have, by its type."""
    rels = taxonomy.frames(spark)["rels"].select(F.col("src_type").alias("type"), F.col("rel").alias("relation")).distinct()
    return _typed(spark, d).join(rels, "type").select("id", "relation")


@query("p13_relations_targeting", with_views("nodes", also=_TYPED) + "SELECT id, src AS from_type, relation FROM typed JOIN (VALUES ('Item', 'Person', 'OWNED_BY'), ('DigitalItem', 'Person', 'CREATED_BY'), ('DigitalItem', 'Person', 'OWNED_BY'), ('Activity', 'Person', 'ASSIGNED_TO'), ('Activity', 'Person', 'INVOLVES'), ('Collection', 'Person', 'OWNED_BY'), ('Information', 'Person', 'CREATED_BY'), ('Person', 'Person', 'KNOWS'), ('Information', 'Person', 'ABOUT'), ('DigitalItem', 'Person', 'DOCUMENTS')) t(src, type, relation) USING (type)")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """The relations that may point at every node that is a person, and the types that they come from."""
    rels = taxonomy.frames(spark)["rels"].select(F.col("dst_type").alias("type"), F.col("src_type").alias("from_type"), F.col("rel").alias("relation")).distinct()
    return _typed(spark, d).where("type = 'Person'").join(rels, "type").select("id", "from_type", "relation")


@query("p12_validate_entities", "SELECT 'Customer_' || c_custkey AS id, 'missing_required' AS problem, 'email' AS property FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'Customer_' || c_custkey, 'not_allowed', 'status' FROM customer WHERE c_custkey % 4 = 0")
def p12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    props = F.create_map(F.lit("email"), F.when(k % 3 != 0, "a@b.c"), F.lit("status"), F.when(k % 4 == 0, "gone").otherwise("active"))
    nodes = T.table(spark, d, "customer").select(F.concat(F.lit("Customer_"), k).alias("id"), F.lit("Member").alias("type"), props.alias("props"))
    rules = spark.createDataFrame([("Party", "email", True, None), ("Member", "status", False, ["active", "inactive"])], "type string, prop string, required boolean, enum array<string>")
    types = spark.createDataFrame([("Party", None), ("Member", "Party")], "type string, parent string")
    return taxonomy.violations(nodes, types, rules)


@query("p14_relation_suggestion", with_views("edges") + ", asked AS (SELECT CASE WHEN src LIKE '%1' THEN lower(type) ELSE type END AS relation FROM edges) SELECT relation, CASE WHEN upper(relation) = 'PART_OF' THEN 'PART_OF' END AS suggestion, relation = 'PART_OF' AS valid, count(*) AS n FROM asked GROUP BY 1, 2, 3")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """The relations of all edges, some in lower case, held against the taxonomy."""
    asked = T.edges(spark, d).select(F.when(F.col("src").like("%1"), F.lower("type")).otherwise(F.col("type")).alias("relation"))
    return taxonomy.suggest(asked, taxonomy.frames(spark)["rels"]).groupBy("relation", "suggestion", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("p11_value_types", """WITH v AS (SELECT o_orderkey AS id, unnest([{'kind': 'Integer', 'value': o_orderkey::VARCHAR, 'valid': true}, {'kind': 'Integer', 'value': o_orderkey || '.5', 'valid': false}, {'kind': 'Float', 'value': o_orderkey || '.5', 'valid': true},
  {'kind': 'Boolean', 'value': CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE o_orderstatus END, 'valid': o_orderkey % 2 = 0}, {'kind': 'Date', 'value': strftime(o_orderdate, '%Y-%m-%d'), 'valid': true},
  {'kind': 'Date', 'value': year(o_orderdate) || '-02-30', 'valid': false}, {'kind': 'Date', 'value': year(o_orderdate) || '-02-29', 'valid': year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)},
  {'kind': 'Email', 'value': 'c' || o_custkey || '@x.org', 'valid': true}, {'kind': 'Email', 'value': o_orderpriority, 'valid': false}, {'kind': 'Text', 'value': o_orderpriority, 'valid': true}]) AS x FROM orders)
  SELECT id, x.kind AS kind, x.value AS value, x.valid AS valid FROM v""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Values of all orders held against types."""
    k, year = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    values = [
        ("Integer", k), ("Integer", F.concat(k, F.lit(".5"))), ("Float", F.concat(k, F.lit(".5"))), ("Boolean", F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise(F.col("o_orderstatus"))),
        ("Date", F.date_format("o_orderdate", "yyyy-MM-dd")), ("Date", F.concat(year, F.lit("-02-30"))), ("Date", F.concat(year, F.lit("-02-29"))),
        ("Email", F.concat(F.lit("c"), "o_custkey", F.lit("@x.org"))), ("Email", F.col("o_orderpriority")), ("Text", F.col("o_orderpriority")),
    ]
    each = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.inline(F.array(*[F.struct(F.lit(t).alias("kind"), v.alias("value")) for t, v in values])))
    return each.select("id", "kind", "value", taxonomy.valid_value(F.col("kind"), F.col("value")).alias("valid"))

