"""Scans, filters, projections, joins, aggregates, order and set operations over entities and statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.sources import tables as T

from .registry import query, with_views

E, S, ES = with_views("entities"), with_views("statements"), with_views("entities", "statements")
N, D = with_views("nodes"), with_views("edges")

# ---- A: scans ------------------------------------------------------------------------------------


@query("a1_table_scan", ES + "SELECT 'contents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'statements', count(*) FROM statements")
def a1(spark: SparkSession, d: str) -> DataFrame:
    parts = [(k, f(spark, d)) for k, f in (("contents", T.contents), ("entities", T.entities), ("statements", T.statements))]
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("source"), "n") for k, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a2_full_scan", E + "SELECT id, kind, name FROM entities")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).select("id", "kind", "name")


@query("a3_point_lookup", E + "SELECT id, name, verification_status FROM entities WHERE id = 42 OR name = 'FRANCE'")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).where((F.col("id") == 42) | (F.col("name") == "FRANCE")).select("id", "name", "verification_status")


@query("a4_label_scan", N + "SELECT id, name FROM nodes WHERE label = 'Supplier'")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where("label = 'Supplier'").select("id", "name")


@query("a5_relationship_scan", with_views("nodes", "edges") + "SELECT a.name AS src_name, e.type, b.name AS dst_name FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst")
def a5(spark: SparkSession, d: str) -> DataFrame:
    n, e = T.nodes(spark, d), T.edges(spark, d)
    a, b = (n.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name")) for k in ("src", "dst"))
    return e.join(a, "src").join(b, "dst").select("src_name", "type", "dst_name")


@query("a6_objects_by_class", N + "SELECT label, min(id) AS first_id, count(*) AS n FROM nodes WHERE label IN ('Nation', 'Region') GROUP BY 1")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where(F.col("label").isin("Nation", "Region")).groupBy("label").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def unique_key(label: Column, name: Column, props: Column) -> Column:
    """The property that identifies an object of a class: file name, VIN, or else the name."""
    return F.when(label == "Document", props["file_name"]).when(label == "Vehicle", props["vin"]).otherwise(name)


@query("a7_unique_key_lookup", N + "SELECT id, name FROM nodes WHERE name IN ('ASIA', 'Supplier#000000007') AND label NOT IN ('Document', 'Vehicle')")
def a7(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d)
    return n.where(unique_key(F.col("label"), F.col("name"), F.col("props")).isin("ASIA", "Supplier#000000007")).select("id", "name")


@query("a12_split_by_extension", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(jpe?g|png|gif|webp)([?#]|$)') THEN 'image' ELSE 'text' END AS kind FROM pages")
def a12(spark: SparkSession, d: str) -> DataFrame:
    image = F.lower("url").rlike(r"\.(jpe?g|png|gif|webp)([?#]|$)")
    return T.table(spark, d, "pages").select("page_id", F.when(image, "image").otherwise("text").alias("kind"))


@query("a15_sql_gateway", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT l_returnflag AS flag, count(*) AS n FROM {items} WHERE l_quantity >= :least GROUP BY l_returnflag", args={"least": 25}, items=T.table(spark, d, "lineitem"))


@query("a17_probe", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS alive FROM {t}" for t in ("nation", "customer", "orders", "lineitem", "events", "documents", "embeddings")))
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Whether each table answers: one row of it is asked for."""
    names = ("nation", "customer", "orders", "lineitem", "events", "documents", "embeddings")
    probes = [T.table(spark, d, t).limit(1).agg((F.count(F.lit(1)) > 0).alias("alive")).select(F.lit(t).alias("name"), "alive") for t in names]
    return reduce(DataFrame.unionByName, probes)


# ---- C: filters ----------------------------------------------------------------------------------


@query("c1_by_name", E + "SELECT id, name FROM entities WHERE name ILIKE '%an%'")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).where(F.col("name").ilike("%an%")).select("id", "name")


@query("c2_by_status", E + "SELECT verification_status, count(*) AS n FROM entities WHERE verification_status IN ('verified', 'pending', 'rejected') GROUP BY 1")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).where(F.col("verification_status").isin("verified", "pending", "rejected")).groupBy("verification_status").agg(F.count(F.lit(1)).alias("n"))


@query("c3_with_embedding", "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label")


@query("c4_with_predicate", S + "SELECT id, entity_id FROM statements WHERE predicate = 'located_in'")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).where("predicate = 'located_in'").select("id", "entity_id")


RELATIONSHIP = "object_type = 'entity' OR object_entity_id IS NOT NULL"
ATTRIBUTE = "object_type = 'literal' OR object_entity_id IS NULL"


@query("c5_relationships", S + f"SELECT id FROM statements WHERE {RELATIONSHIP}")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).where(RELATIONSHIP).select("id")


@query("c6_attributes", S + f"SELECT id FROM statements WHERE {ATTRIBUTE}")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).where(ATTRIBUTE).select("id")


@query("c7_partition", S + "SELECT object_entity_id IS NOT NULL AS is_relationship, count(*) AS n FROM statements GROUP BY 1")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).groupBy(F.col("object_entity_id").isNotNull().alias("is_relationship")).agg(F.count(F.lit(1)).alias("n"))


def having(props: Column, wanted: dict[str, str]) -> Column:
    """Equality of every wanted property."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce(props[k] == v, F.lit(False))
    return out


@query("c8_property_equality", "SELECT 'Part_' || p_partkey AS id FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where(having(F.col("props"), {"p_brand": "Brand#2", "p_type": "ECONOMY"})).select("id")


@query(
    "c9_constraint_match",
    N + """SELECT n.new_id, n.match_id FROM (SELECT 'new_' || x.id AS new_id, y.id AS match_id, row_number() OVER (PARTITION BY x.id ORDER BY CASE WHEN y.id = x.id THEN 0 ELSE 1 END, y.id) AS r
    FROM nodes x JOIN nodes y ON x.label = y.label AND (x.id = y.id OR x.name = y.name) WHERE x.label IN ('Nation', 'Region', 'Part')) n WHERE r = 1""",
)
def c9(spark: SparkSession, d: str) -> DataFrame:
    """Same id first, else the unique property (name) alike; one match for each new node, the lowest id."""
    n = T.nodes(spark, d)
    new = n.where(F.col("label").isin("Nation", "Region", "Part")).select(F.col("id").alias("x_id"), "label", "name")
    by_id = new.select("x_id", "label").join(n.select(F.col("id").alias("x_id"), "label"), ["x_id", "label"]).select("x_id", F.col("x_id").alias("match_id"), F.lit(0).alias("stage"))
    # Only the lowest id of a name is asked for, so that a frequent name costs one row a node.
    low = n.groupBy("label", "name").agg(F.min("id").alias("match_id"))
    by_name = new.join(low, ["label", "name"]).select("x_id", "match_id", F.lit(1).alias("stage"))
    best = by_id.unionByName(by_name).groupBy("x_id").agg(F.min(F.struct("stage", "match_id")).alias("m"))
    return best.select(F.concat(F.lit("new_"), "x_id").alias("new_id"), "m.match_id")


@query("c10_label_any_case", N + "SELECT id FROM nodes WHERE lower(label) IN ('nation', 'region')")
def c10(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array("label")
    return T.nodes(spark, d).where(F.exists(labels, lambda x: F.lower(x).isin("nation", "region"))).select("id")


@query("c11_property_contains", "SELECT 'Part_' || p_partkey AS id FROM part WHERE lower(p_brand) LIKE '%#17%' OR lower(p_type) LIKE '%#17%'")
def c11(spark: SparkSession, d: str) -> DataFrame:
    values = F.map_values(F.map_filter("props", lambda k, v: k != "embedding"))
    return T.nodes(spark, d).where("label = 'Part'").where(F.exists(values, lambda v: F.instr(F.lower(v), "#17") > 0)).select("id")


@query("c12_valid_or_suggested", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'suggested' ELSE 'valid' END AS kind FROM events")
def c12(spark: SparkSession, d: str) -> DataFrame:
    suggested = F.when(F.col("event_type") == "error", F.col("event_type"))
    return T.table(spark, d, "events").select("event_id", F.when(suggested.isNotNull(), "suggested").otherwise("valid").alias("kind"))


def needs_update(old: Column, new: Column) -> Column:
    """Whether any new property differs from the old one."""
    return F.exists(F.map_entries(new), lambda e: ~old[e["key"]].eqNullSafe(e["value"]))


@query("c13_needs_update", "SELECT 'Part_' || p_partkey AS id FROM part WHERE p_brand <> 'Brand#2'")
def c13(spark: SparkSession, d: str) -> DataFrame:
    new = F.create_map(F.lit("p_brand"), F.lit("Brand#2"))
    return T.nodes(spark, d).where("label = 'Part'").where(needs_update(F.col("props"), new)).select("id")


@query("c14_pending_exists", ES + "SELECT id FROM entities e WHERE verification_status = 'pending' AND EXISTS (SELECT 1 FROM statements s WHERE s.entity_id = e.id)")
def c14(spark: SparkSession, d: str) -> DataFrame:
    s = T.statements(spark, d).select(F.col("entity_id").alias("id"))
    return T.entities(spark, d).where("verification_status = 'pending'").join(s, "id", "left_semi").select("id")


# ---- D: projections ------------------------------------------------------------------------------


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Statements with subject and object names."""
    e = T.entities(spark, d)
    s = T.statements(spark, d)
    subject = e.select(F.col("id").alias("entity_id"), F.col("name").alias("subject"))
    other = e.select(F.col("id").alias("object_entity_id"), F.col("name").alias("object_name"))
    return s.join(subject, "entity_id").join(other, "object_entity_id", "left")


_TRIPLE = "CASE WHEN coalesce(o.name, s.object) IS NOT NULL THEN e.name || ' ' || s.predicate || ' ' || coalesce(o.name, s.object) ELSE s.text END"
_TRIPLES = "FROM statements s JOIN entities e ON e.id = s.entity_id LEFT JOIN entities o ON o.id = s.object_entity_id"


@query("d1_to_triple", ES + f"SELECT s.id, {_TRIPLE} AS triple {_TRIPLES}")
def d1(spark: SparkSession, d: str) -> DataFrame:
    o = F.coalesce("object_name", "object")
    return triples(spark, d).select("id", F.when(o.isNotNull(), F.concat_ws(" ", "subject", "predicate", o)).otherwise(F.col("text")).alias("triple"))


@query("d2_display", ES + f"SELECT s.id, {_TRIPLE} || ' (' || round(s.confidence, 2)::DECIMAL(4, 2) || ')' AS line {_TRIPLES}")
def d2(spark: SparkSession, d: str) -> DataFrame:
    o = F.coalesce("object_name", "object")
    triple = F.when(o.isNotNull(), F.concat_ws(" ", "subject", "predicate", o)).otherwise(F.col("text"))
    return triples(spark, d).select("id", F.concat(triple, F.lit(" ("), F.round("confidence", 2).cast("decimal(4,2)").cast("string"), F.lit(")")).alias("line"))


@query("d3_relationship_projection", D + "SELECT DISTINCT type, src, dst FROM edges")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).select("type", "src", "dst").distinct()


@query("d4_matcher_columns", "SELECT 'Part_' || p_partkey AS id, p_name AS name, p_brand AS brand FROM part UNION ALL SELECT 'Customer_' || c_custkey, c_name, NULL FROM customer")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where(F.col("label").isin("Part", "Customer")).select("id", "name", F.col("props")["p_brand"].alias("brand"))


@query("d5_strip_embeddings", "SELECT 'Part_' || p_partkey AS id, 2::INTEGER AS n_props FROM part")
def d5(spark: SparkSession, d: str) -> DataFrame:
    p = F.map_concat("props", F.create_map(F.lit("embedding"), F.lit("[0.1]")))
    return T.nodes(spark, d).where("label = 'Part'").select("id", F.size(F.map_filter(p, lambda k, v: ~k.contains("embedding"))).alias("n_props"))


@query("d9_similarity_percent", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) * 100, 1) + 0.0 AS percent FROM embeddings")
def d9(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.functions.vector import cosine

    e = T.table(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", (F.round(cosine(F.col("embedding"), q) * 100, 1) + 0.0).alias("percent"))


@query("d11_name_cleanup", "SELECT doc_id, nullif(trim(split_part(text, '\n', 1)), '') AS name FROM documents")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.nullif(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("")).alias("name"))


# ---- E: joins ------------------------------------------------------------------------------------


@query("e1_with_statements", ES + "SELECT id FROM entities WHERE id IN (SELECT entity_id FROM statements)")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).join(T.statements(spark, d).select(F.col("entity_id").alias("id")), "id", "left_semi").select("id")


@query("e2_without_statements", ES + "SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM statements)")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).join(T.statements(spark, d).select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("e3_eager_load", ES + "SELECT s.id, e.name AS subject, o.name AS object_name, d.lang FROM statements s JOIN entities e ON e.id = s.entity_id LEFT JOIN entities o ON o.id = s.object_entity_id JOIN documents d ON d.doc_id = s.content_id")
def e3(spark: SparkSession, d: str) -> DataFrame:
    c = T.contents(spark, d).select(F.col("id").alias("content_id"), "lang")
    return triples(spark, d).join(c, "content_id").select("id", "subject", "object_name", "lang")


@query("e4_left_chain", ES + "SELECT d.doc_id AS content_id, count(DISTINCT e.id) AS n_entities, count(s.id) AS n_statements FROM documents d LEFT JOIN entities e ON e.content_id = d.doc_id LEFT JOIN statements s ON s.entity_id = e.id GROUP BY 1")
def e4(spark: SparkSession, d: str) -> DataFrame:
    c = T.contents(spark, d).select(F.col("id").alias("content_id"))
    per = T.statements(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    # Statements are counted before the join, so that it has one row for each entity.
    e = T.entities(spark, d).select("id", "content_id").join(per, F.col("id") == F.col("entity_id"), "left")
    g = e.groupBy("content_id").agg(F.count("id").alias("n_entities"), F.sum(F.coalesce("n", F.lit(0))).alias("n_statements"))
    return c.join(g, "content_id", "left").select("content_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_statements", F.lit(0)).alias("n_statements"))


@query("e5_contents_with_entities", E + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT content_id FROM entities)")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").join(T.entities(spark, d).select(F.col("content_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id")


@query("e6_endpoint_by_name", E + "SELECT p_name AS name, min(id) AS id FROM part JOIN entities ON name = p_name AND kind = 'Part' GROUP BY 1")
def e6(spark: SparkSession, d: str) -> DataFrame:
    """The lowest id of each name that an edge asks for."""
    asked = T.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    e = T.entities(spark, d).where("kind = 'Part'").groupBy("name").agg(F.min("id").alias("id"))
    return asked.join(e, "name").select("name", "id")


UNRESOLVED = ["widget", "brand#21", "nothing like it"]


@query(
    "e7_endpoint_fallback",
    "SELECT q.name, min('Part_' || p_partkey) AS id FROM part, (SELECT unnest(['widget', 'brand#21', 'nothing like it']) AS name) q WHERE contains(lower(p_name), q.name) OR contains(lower(p_brand), q.name) OR contains(lower(p_type), q.name) GROUP BY 1",
)
def e7(spark: SparkSession, d: str) -> DataFrame:
    """Names that no node has, looked up within properties: each node tests the (few, given) names itself, one pass."""
    n = T.nodes(spark, d).where("label = 'Part'")
    values = F.transform(F.array_append(F.map_values("props"), F.col("name")), F.lower)
    hits = F.filter(F.array(*[F.lit(x) for x in UNRESOLVED]), lambda q: F.exists(values, lambda v: F.contains(v, q)))
    return n.select("id", F.explode(hits).alias("name")).groupBy("name").agg(F.min("id").alias("id"))


@query("e8_dangling_references", with_views("nodes", "edges") + "SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE label <> 'Region') OR dst NOT IN (SELECT id FROM nodes WHERE label <> 'Region')")
def e8(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d).where("label <> 'Region'").select("id")
    e = T.edges(spark, d)
    bad = [e.join(n.withColumnRenamed("id", k), k, "left_anti").select("src", "dst", "type") for k in ("src", "dst")]
    return bad[0].unionByName(bad[1]).distinct()


@query("e9_valid_links", with_views("nodes", "edges") + "SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM nodes WHERE label <> 'Region') AND dst IN (SELECT id FROM nodes WHERE label <> 'Region')")
def e9(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d).where("label <> 'Region'").select("id")
    return T.edges(spark, d).join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


@query("e12_pair_exists", with_views("nodes") + "SELECT 'both' AS state, (SELECT count(*) FROM nodes WHERE id IN ('Customer_1', 'Nation_3')) = 2 AS found")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where(F.col("id").isin("Customer_1", "Nation_3")).agg((F.count(F.lit(1)) == 2).alias("found")).select(F.lit("both").alias("state"), "found")


@query(
    "e13_candidate_requests",
    ES + """, per AS (SELECT entity_id, count(*) AS n FROM statements GROUP BY 1),
    same AS (SELECT name, kind, list({'id': id, 'n': coalesce(n, 0)} ORDER BY id) AS l FROM entities LEFT JOIN per ON entity_id = id WHERE kind = 'Part' GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT name, len(l)::INTEGER AS n_similar, list_sum(list_transform(l, lambda x: x.n))::BIGINT AS statement_count FROM same""",
)
def e13(spark: SparkSession, d: str) -> DataFrame:
    per = T.statements(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    e = T.entities(spark, d).where("kind = 'Part'").join(per, F.col("id") == F.col("entity_id"), "left")
    g = e.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n")))).alias("similar")).where(F.size("similar") > 1)
    return g.select("name", F.size("similar").alias("n_similar"), F.aggregate("similar", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("statement_count"))


@query("e14_object_by_name", ES + "SELECT s.id, min(e.id) AS object_id FROM statements s LEFT JOIN entities e ON e.name = s.object WHERE s.object IS NOT NULL GROUP BY 1")
def e14(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d).groupBy(F.col("name").alias("object")).agg(F.min("id").alias("object_id"))
    return T.statements(spark, d).where("object is not null").select("id", "object").join(e, "object", "left").select("id", "object_id")


# ---- K: aggregates -------------------------------------------------------------------------------


@query("k1_nodes_by_label", N + "SELECT label, count(*) AS n FROM nodes GROUP BY 1")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query("k2_edges_by_type", D + "SELECT type, count(*) AS n FROM edges GROUP BY 1")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


@query("k3_totals", N + "SELECT count(*) AS n_nodes, count(DISTINCT label) AS n_labels FROM nodes")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_labels"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(0.0)


@query(
    "k4_inventory_stats",
    ES + f"""SELECT count(*) AS n_statements, count(*) FILTER (WHERE {RELATIONSHIP}) AS n_relationships, count(*) FILTER (WHERE {ATTRIBUTE}) AS n_attributes,
    round(count(*) FILTER (WHERE {RELATIONSHIP}) * 100.0::DOUBLE / count(*), 1) AS relationships_pct, round(count(*) FILTER (WHERE {ATTRIBUTE}) * 100.0::DOUBLE / count(*), 1) AS attributes_pct,
    round(count(*)::DOUBLE / (SELECT count(*) FROM entities), 2) AS per_entity FROM statements""",
)
def k4(spark: SparkSession, d: str) -> DataFrame:
    s = T.statements(spark, d).agg(F.count(F.lit(1)).alias("n_statements"), F.count_if(F.expr(RELATIONSHIP)).alias("n_relationships"), F.count_if(F.expr(ATTRIBUTE)).alias("n_attributes"))
    n = T.entities(spark, d).agg(F.count(F.lit(1))).scalar()
    total = F.col("n_statements")
    return s.select("*", percent(F.col("n_relationships"), total).alias("relationships_pct"), percent(F.col("n_attributes"), total).alias("attributes_pct"), F.when(n > 0, F.round(total / n, 2)).otherwise(0.0).alias("per_entity"))


@query("k5_latest_contents", E + "SELECT c.doc_id AS content_id, count(e.id) AS n_entities FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 5) c LEFT JOIN entities e ON e.content_id = c.doc_id GROUP BY 1")
def k5(spark: SparkSession, d: str) -> DataFrame:
    c = T.contents(spark, d).select(F.col("id").alias("content_id")).orderBy(F.desc("content_id")).limit(5)  # the report shows the latest five
    e = T.entities(spark, d).select("content_id", "id").join(F.broadcast(c), "content_id", "left_semi")
    g = e.groupBy("content_id").agg(F.count("id").alias("n_entities"))
    return c.join(g, "content_id", "left").select("content_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


@query("k6_by_predicate", S + "SELECT entity_id, predicate, count(*) AS n, min(id) AS first_id FROM statements GROUP BY 1, 2")
def k6(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).groupBy("entity_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("k6_referenced_by_predicate", S + "SELECT object_entity_id, predicate, count(*) AS n FROM statements WHERE object_entity_id IS NOT NULL GROUP BY 1, 2")
def k6b(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).where("object_entity_id is not null").groupBy("object_entity_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


@query("k7_duplicate_groups", E + "SELECT kind, name, count(*) AS n FROM entities GROUP BY 1, 2 HAVING count(*) > 1")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("k12_statement_counts", ES + "SELECT e.id, count(s.id) AS statement_count FROM entities e LEFT JOIN statements s ON s.entity_id = e.id GROUP BY 1")
def k12(spark: SparkSession, d: str) -> DataFrame:
    per = T.statements(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return T.entities(spark, d).select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("statement_count"))


# ---- M: order and top-k; N: set operations -------------------------------------------------------


@query("m1_by_name", E + "SELECT id, name FROM entities ORDER BY name, id LIMIT 50")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).select("id", "name").orderBy("name", "id").limit(50)


@query("m2_by_confidence", S + "SELECT id, confidence FROM statements ORDER BY confidence DESC, id LIMIT 50")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(50)


@query("m3_page", E + "SELECT id, name, (SELECT count(*) FROM entities) AS total FROM entities ORDER BY id LIMIT 20 OFFSET 40")
def m3(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d)
    total = e.agg(F.count(F.lit(1))).scalar()
    return e.select("id", "name").orderBy("id").offset(40).limit(20).withColumn("total", total)


@query("m4_limit_per_parent", S + "SELECT entity_id, id FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id) AS r FROM statements) WHERE r <= 3")
def m4(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "id")
    return T.statements(spark, d).select("entity_id", "id", "confidence").withColumn("r", F.row_number().over(w)).where("r <= 3").select("entity_id", "id")


@query("m6_sample", N + "SELECT id, name FROM nodes ORDER BY id LIMIT 10")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).select("id", "name").orderBy("id").limit(10)


@query("n1_union_endpoints", D + "SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def n1(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query("n2_concat_unique", E + "SELECT DISTINCT id FROM (SELECT id FROM entities WHERE name ILIKE '%a%' UNION ALL SELECT id FROM entities WHERE verification_status = 'pending')")
def n2(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d)
    return e.where(F.col("name").ilike("%a%")).select("id").unionByName(e.where("verification_status = 'pending'").select("id")).dropDuplicates(["id"])


@query("n3_array_sets", "SELECT n_nationkey, len(list_intersect(l, ['A', 'E', 'I']))::INTEGER AS n_common, len(list_filter(['A', 'E', 'I'], lambda x: NOT list_contains(l, x)))::INTEGER AS n_missing FROM (SELECT n_nationkey, string_split(n_name, '') AS l FROM nation)")
def n3(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("A"), F.lit("E"), F.lit("I"))
    own = F.split("n_name", "")
    return T.table(spark, d, "nation").select("n_nationkey", F.size(F.array_intersect(own, wanted)).alias("n_common"), F.size(F.array_except(wanted, own)).alias("n_missing"))


@query("n4_first_seen", S + "SELECT object_entity_id, min(id) AS first_seen FROM statements WHERE object_entity_id IS NOT NULL GROUP BY 1")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return T.statements(spark, d).where("object_entity_id is not null").groupBy("object_entity_id").agg(F.min("id").alias("first_seen"))
