"""Writes, merges, verification and review as state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.functions import vector as V
from quillgraph.lineage import cut, scratch
from quillgraph.operators import state as X
from quillgraph.snapshots import Conflict, Store
from quillgraph.sources import tables as T

from .registry import query, with_views

ES, ND = with_views("entities", "statements"), with_views("nodes", "edges")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the part nodes, and a batch that has every second part twice, with other properties."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    n = T.nodes(spark, d).where("label = 'Part'")
    half = n.where(k % 2 == 0)
    lit = lambda *x: F.create_map(*[F.lit(v) for v in x])
    one = half.withColumn("props", lit("p_brand", "New", "seen", "a"))
    two = half.withColumn("props", F.create_map(F.lit("seen"), F.lit("b"), F.lit("more"), k.cast("string"))).withColumn("name", F.lit(None).cast("string"))
    return n.where(k % 3 != 0), one.unionByName(two)


@query("b9_create_nodes", "SELECT 'Part_' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def b9(spark: SparkSession, d: str) -> DataFrame:
    old, new = _parts(spark, d)
    made = X.upsert_nodes(old.limit(0), new)
    return old.unionByName(made.join(old.select("id"), "id", "left_anti").select(*old.columns)).select("id", "name")


@query("b10_update_props", "SELECT 'Part_' || p_partkey AS id, 'New' AS brand, p_type AS type, 'b' AS seen, p_partkey::VARCHAR AS more FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def b10(spark: SparkSession, d: str) -> DataFrame:
    old, new = _parts(spark, d)
    m = F.col("props")
    after = X.upsert_nodes(old, new.join(old.select("id"), "id", "left_semi")).join(new.select("id").distinct(), "id", "left_semi")
    return after.select("id", m["p_brand"].alias("brand"), m["p_type"].alias("type"), m["seen"].alias("seen"), m["more"].alias("more"))


_UPSERTED = "SELECT 'Part_' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'New' ELSE p_brand END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS more FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"


@query("b11_upsert_nodes", _UPSERTED)
def b11(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return X.upsert_nodes(*_parts(spark, d)).select("id", "name", p["p_brand"].alias("brand"), p["p_type"].alias("type"), p["more"].alias("more"))


@query("b11_upsert_versions", _UPSERTED)
def b11b(spark: SparkSession, d: str) -> DataFrame:
    """The same through versioned buckets: the nodes as version 0, the batch as version 1."""
    old, new = _parts(spark, d)
    store = Store(spark, scratch(spark))
    for batch in (old, new):
        tx = store.begin()
        tx.create("nodes", StructType.fromDDL("id string, label string, name string, props map<string,string>"), ["id"])
        tx.change("nodes", batch, X.upsert_nodes)
        tx.commit()
    p = F.col("props")
    return store.read("nodes").select("id", "name", p["p_brand"].alias("brand"), p["p_type"].alias("type"), p["more"].alias("more"))


@query("a15_transactions", "SELECT 'Part_' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE p_name END AS name, 1::BIGINT AS version, 'conflict' AS second, 0::BIGINT AS rolled_back FROM part")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Three transactions over all parts: one that renames every second part commits, one that began beside it and changes every third loses, one is rolled back."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    n = T.nodes(spark, d).where("label = 'Part'")
    store = Store(spark, scratch(spark))
    load = store.begin()
    load.create("nodes", StructType.fromDDL("id string, label string, name string, props map<string,string>"), ["id"])
    load.change("nodes", n, X.upsert_nodes)
    load.commit()
    first, second, third = store.begin(), store.begin(), store.begin()
    first.change("nodes", n.where(k % 2 == 0).withColumn("name", F.lit("first")), X.upsert_nodes)
    second.change("nodes", n.where(k % 3 == 0).withColumn("name", F.lit("second")), X.upsert_nodes)
    third.change("nodes", n.withColumn("name", F.lit("third")), X.upsert_nodes)
    third.rollback()
    version = first.commit()
    try:
        second.commit()
        said = "committed"
    except Conflict:
        said = "conflict"
    seen = F.coalesce((F.col("name") == "third").cast("long"), F.lit(0))
    return store.read("nodes").select("id", "name", F.lit(version).cast("long").alias("version"), F.lit(said).alias("second"), seen.alias("rolled_back"))


@query(
    "b12_upsert_by_unique_key",
    """WITH base AS (SELECT p_name AS key, min(p_partkey) FILTER (WHERE p_partkey % 3 <> 0) AS old_id, max(p_brand) FILTER (WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 1) AS b1,
      max(p_type) FILTER (WHERE p_partkey % 2 = 0) AS t2, min(p_partkey) FILTER (WHERE p_partkey % 2 = 0) AS new_id, max(p_brand) FILTER (WHERE p_partkey % 3 <> 0) AS b_old FROM part GROUP BY 1)
    SELECT key, 'Part_' || coalesce(old_id, new_id) AS id, old_id IS NULL AS created, b_old AS brand, t2 AS type FROM base WHERE old_id IS NOT NULL OR new_id IS NOT NULL""",
)
def b12(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the batch go into the stored one of the same unique key (for parts their name), which keeps its id; others are made under their lowest id."""
    from .relational import unique_key

    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    n = T.nodes(spark, d).where("label = 'Part'").withColumn("key", unique_key(F.col("label"), F.col("name"), F.col("props"))).withColumn("k", k)
    old = n.where(k % 3 != 0).withColumn("props", F.map_filter("props", lambda p, _: p == "p_brand"))
    new = n.where(k % 2 == 0).withColumn("props", F.map_filter("props", lambda p, _: p == "p_type"))
    after = X.upsert_by_key(old, new)
    p = F.col("props")
    return after.select("key", F.concat(F.lit("Part_"), "k").alias("id"), "created", p["p_brand"].alias("brand"), p["p_type"].alias("type"))


@query("b13_detach_delete", ND + "SELECT src, dst, type FROM edges WHERE src NOT IN ('Nation_1', 'Nation_2') AND dst NOT IN ('Nation_1', 'Nation_2')")
def b13(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("Nation_1",), ("Nation_2",)], "id string")
    return X.delete_nodes(T.nodes(spark, d), T.edges(spark, d), gone)[1].select("src", "dst", "type")


@query("b14_truncate", ND + "SELECT count(*) AS n FROM nodes WHERE false")
def b14(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).limit(0).agg(F.count(F.lit(1)).alias("n"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers' edges with a property, and a batch of customers' and suppliers' edges, each twice with other properties."""
    e = T.edges(spark, d).where("type = 'LOCATED_IN'")
    old = e.where("src like 'Customer%'").withColumn("props", F.create_map(F.lit("w"), F.lit("1")))
    one, two = e.withColumn("props", F.create_map(F.lit("v"), F.lit("2"))), e.withColumn("props", F.create_map(F.lit("v"), F.lit("3"), F.lit("u"), F.col("dst")))
    return old, one.unionByName(two)


@query("b15_merge_edges", ND + "SELECT src, dst, CASE WHEN src LIKE 'Customer%' THEN '1' END AS w, '3' AS v, dst AS u FROM edges WHERE type = 'LOCATED_IN'")
def b15(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return X.merge_edges(*_edges(spark, d)).select("src", "dst", p["w"].alias("w"), p["v"].alias("v"), p["u"].alias("u"))


@query("b16_insert_if_absent", ND + "SELECT src, dst, CASE WHEN src LIKE 'Customer%' THEN '1' END AS w, CASE WHEN src NOT LIKE 'Customer%' THEN '3' END AS v, CASE WHEN src NOT LIKE 'Customer%' THEN dst END AS u FROM edges WHERE type = 'LOCATED_IN'")
def b16(spark: SparkSession, d: str) -> DataFrame:
    """Of an edge that the batch has twice the first as text ({"u": ...} before {"v": ...}) is inserted, with its properties only."""
    p = F.col("props")
    return X.insert_edges(*_edges(spark, d)).select("src", "dst", p["w"].alias("w"), p["v"].alias("v"), p["u"].alias("u"))


@query("b17_add_reference", ND + "SELECT src, dst, type FROM edges WHERE type = 'PART_OF'")
def b17(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d).where("type = 'PART_OF'").withColumn("props", F.create_map(F.lit("k"), F.lit("v")))
    return X.insert_edges(e, e).select("src", "dst", "type")


@query("b18_dry_run", "SELECT (2 * (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM supplier))::BIGINT AS total, (SELECT count(*) FROM supplier)::BIGINT AS created, (2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier))::BIGINT AS skipped")
def b18(spark: SparkSession, d: str) -> DataFrame:
    return X.insert_stats(*_edges(spark, d))


@query("b19_schema_evolution", "SELECT n_nationkey, NULL::VARCHAR AS note FROM nation")
def b19(spark: SparkSession, d: str) -> DataFrame:
    return X.evolve(T.table(spark, d, "nation"), {"n_name": "string", "note": "string"}).select("n_nationkey", "note")


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Every customer whose key ends in 7 goes into the customer before it."""
    c = T.table(spark, d, "customer").where("c_custkey % 10 = 7")
    return c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - 1).alias("target_id"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """All statements, and of every customer that it knows the next one: twice for some, once with more confidence."""
    c = T.table(spark, d, "customer").withColumn("again", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = F.col("c_custkey")
    confidence = F.when(F.col("again") == 1, F.lit(0.95)).otherwise((k % 90) / 100)
    knows = c.select((F.lit(10_000_000_000) + k * 2 + F.col("again")).alias("id"), k.alias("entity_id"), (k - k % 10 + 17).alias("object_entity_id"), F.lit("knows").alias("predicate"), F.lit(None).cast("string").alias("object"), F.lit("entity").alias("object_type"), confidence.alias("confidence"), F.lit("knows").alias("text"), (k % 1000).alias("content_id"))
    return T.statements(spark, d).unionByName(knows)


_LINKED = """linked AS (SELECT id, entity_id, object_entity_id, predicate, object, object_type, confidence FROM statements
  UNION ALL SELECT 10000000000 + c_custkey * 2 + again, c_custkey, c_custkey - c_custkey % 10 + 17, 'knows', NULL, 'entity', CASE WHEN again = 1 THEN 0.95 ELSE c_custkey % 90 / 100 END FROM customer, (VALUES (0), (1)) v(again) WHERE again = 0 OR c_custkey % 3 = 0),
 goals AS (SELECT c_custkey AS source_id, c_custkey - 1 AS target_id FROM customer WHERE c_custkey % 10 = 7),
 touched AS (SELECT l.*, source_id, coalesce(target_id, entity_id) AS owner FROM linked l LEFT JOIN goals ON source_id = entity_id WHERE source_id IS NOT NULL OR entity_id IN (SELECT target_id FROM goals)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY owner, predicate, object, object_type, object_entity_id ORDER BY source_id IS NOT NULL, id) AS r,
   max(confidence) FILTER (WHERE source_id IS NOT NULL) OVER (PARTITION BY owner, predicate, object, object_type, object_entity_id) AS most FROM touched),
 merged AS (SELECT id, owner AS entity_id, predicate, object, object_type, object_entity_id, CASE WHEN r = 1 THEN greatest(confidence, coalesce(most, confidence)) ELSE confidence END AS confidence, source_id FROM ranked WHERE r = 1 OR source_id IS NULL
   UNION ALL SELECT id, entity_id, predicate, object, object_type, object_entity_id, confidence, NULL FROM linked WHERE id NOT IN (SELECT id FROM touched))"""


@query("j5_merge_into", with_views("statements", also=_LINKED) + "SELECT id, entity_id, predicate, object, object_type, coalesce(target_id, object_entity_id) AS object_entity_id, confidence FROM merged LEFT JOIN goals ON goals.source_id = object_entity_id")
def j5(spark: SparkSession, d: str) -> DataFrame:
    after = X.merge_into(T.entities(spark, d), _linked(spark, d), _merges(spark, d), followed=True)[1]
    return after.select("id", *X.STATEMENT_KEY, "confidence")


@query("j5_merge_audit", with_views("statements", also=_LINKED) + "SELECT goals.source_id, goals.target_id, count(m.id) AS transferred FROM goals LEFT JOIN merged m ON m.source_id = goals.source_id GROUP BY 1, 2")
def j5b(spark: SparkSession, d: str) -> DataFrame:
    return X.merge_into(T.entities(spark, d), _linked(spark, d), _merges(spark, d), followed=True)[2]


@query("j5_merge_chain", "SELECT c_custkey AS source_id, c_custkey - c_custkey % 50 AS target_id FROM customer WHERE c_custkey % 50 <> 0")
def j5c(spark: SparkSession, d: str) -> DataFrame:
    """Chains of 49 merges each, through all customers."""
    c = T.table(spark, d, "customer").where("c_custkey % 50 <> 0")
    return X.follow(c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - 1).alias("target_id")))


@query("j6_merge_copy", ES + "SELECT (SELECT count(*) FROM statements) + count(*) AS n_statements, count(*) AS n_copies FROM statements WHERE entity_id % 10 = 7 AND entity_id < 1000000000")
def j6(spark: SparkSession, d: str) -> DataFrame:
    after = X.merge_copy(T.entities(spark, d), T.statements(spark, d), _merges(spark, d))[1]
    return after.agg(F.count(F.lit(1)).alias("n_statements"), F.count("copy_of").alias("n_copies"))


@query("j7_merge_preview", with_views("statements") + "SELECT count(*) FILTER (WHERE entity_id = 7) AS source_subject, count(*) FILTER (WHERE object_entity_id = 7) AS source_object, count(*) FILTER (WHERE entity_id = 6) AS target_subject, count(*) FILTER (WHERE object_entity_id = 6) AS target_object FROM statements")
def j7(spark: SparkSession, d: str) -> DataFrame:
    s, o = F.col("entity_id"), F.col("object_entity_id")
    return T.statements(spark, d).where(s.isin(6, 7) | o.isin(6, 7)).agg(F.count_if(s == 7).alias("source_subject"), F.count_if(o == 7).alias("source_object"), F.count_if(s == 6).alias("target_subject"), F.count_if(o == 6).alias("target_object"))


@query("j8_mark_verified", with_views("entities") + "SELECT id, CASE WHEN kind = 'Nation' THEN 'verified' ELSE verification_status END AS verification_status FROM entities")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return T.entities(spark, d).select("id", F.when(F.col("kind") == "Nation", "verified").otherwise(F.col("verification_status")).alias("verification_status"))


@query("j9_exact_dedup", with_views("entities") + "SELECT kind, name, min(id) AS id FROM entities GROUP BY 1, 2")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return X.keep_lowest(T.entities(spark, d), "kind", "name")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    lit = F.lit
    one = F.struct(lit("made_of").alias("predicate"), F.col("p_type").alias("object"), lit(None).cast("string").alias("object_type"), lit(None).cast("double").alias("confidence"))
    two = F.struct(lit("brand").alias("predicate"), F.col("p_brand").alias("object"), lit("entity").alias("object_type"), lit(0.9).alias("confidence"))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("candidate_name"), F.array(one, two).alias("pending"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    action = F.when(k % 4 == 0, "use_existing").when(k % 4 == 1, "create_new").when(k % 4 == 2, "merge").otherwise("reject")
    return T.table(spark, d, "part").where(k % 5 != 0).select(k.alias("request_id"), action.alias("action"), (k + T.PART).alias("entity_id"))


_TAKEN = f"SELECT CASE p_partkey % 4 WHEN 1 THEN -p_partkey ELSE p_partkey + {T.PART} END AS entity_id, p_name, p_type, p_brand FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 < 3"


@query(
    "j4_replay_statements",
    f"""SELECT entity_id, p_name || ' made_of ' || p_type AS text, 'made_of' AS predicate, p_type AS object, 'literal' AS object_type, 0.7::DOUBLE AS confidence, 'verification' AS source FROM ({_TAKEN})
    UNION ALL SELECT entity_id, p_name || ' brand ' || p_brand, 'brand', p_brand, 'entity', 0.9, 'verification' FROM ({_TAKEN})""",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    return X.decide(_requests(spark, d), _decisions(spark, d))[2]


@query("j3_decide_requests", f"SELECT p_partkey AS request_id, CASE WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_partkey % 4 = 3 THEN 'rejected' WHEN p_partkey % 4 = 2 THEN 'merged' ELSE 'approved' END AS status, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 1 THEN -p_partkey ELSE p_partkey + {T.PART} END AS verified_entity_id FROM part")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return X.decide(_requests(spark, d), _decisions(spark, d))[0].select("request_id", "status", "verified_entity_id")


@query("j10_created_entities", "SELECT -p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 = 1")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return X.decide(_requests(spark, d), _decisions(spark, d))[1].select("id", "name")


_GRAMS = "list_transform(range(1, length(trim({0})) + 1), lambda i: ('0x' || substr(md5(substr(' ' || lower(trim({0})) || ' ', i, 3)), 1, 8))::BIGINT % 256)"
_NGRAM = "list_transform(range(0, 256), lambda b: len(list_filter({0}, lambda g: g = b))::DOUBLE)"
_SIMILAR = f"""asked AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name || ' Ltd' WHEN 2 THEN 'Q' || md5(s_name) ELSE 'The ' || s_name END AS name FROM supplier),
 stored AS (SELECT id, {_GRAMS.format('name')} AS g FROM entities), wanted AS (SELECT *, {_GRAMS.format('name')} AS g FROM asked),
 own AS MATERIALIZED (SELECT id, {_NGRAM.format('g')} AS v FROM stored), q AS MATERIALIZED (SELECT request_id, name, {_NGRAM.format('g')} AS v FROM wanted),
 near AS (SELECT request_id, q.name, own.id, round(list_cosine_similarity(q.v, own.v), 10) AS s FROM q, own),
 similar_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, id) AS r FROM near WHERE s >= 0.8) WHERE r <= 5)"""


def similars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities that are asked for (all suppliers' names: as they are, with an addition, or quite other ones), and the five
    stored ones of any kind most similar to each by the embedding of the name, 0.8 at least."""
    k, own = F.col("s_suppkey"), F.col("s_name")
    name = F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(own, F.lit(" Ltd"))).when(k % 4 == 2, F.concat(F.lit("Q"), F.md5(own))).otherwise(F.concat(F.lit("The "), own))
    asked = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), name.alias("name"))
    near = V.nearest_names(asked.select(F.col("request_id").alias("id"), "name"), T.entities(spark, d).select("id", "name"), 5, least=0.8)
    return asked, near.select(F.col("query_id").alias("request_id"), "id", "similarity", "rank")


@query("j1_needs_verification", with_views("entities", also=_SIMILAR) + "SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM similar_) THEN 'needs_verification' ELSE 'created' END AS status FROM asked")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """An entity that a stored one resembles waits for verification; any other is created at once."""
    asked, near = similars(spark, d)
    j = asked.join(near.select("request_id", F.lit(True).alias("hit")).distinct(), "request_id", "left")
    return j.select("request_id", F.when(F.col("hit"), "needs_verification").otherwise("created").alias("status"))


@query("j2_request_with_similars", with_views("entities", also=_SIMILAR) + "SELECT request_id, any_value(name) AS candidate_name, count(*)::INTEGER AS n_similar, min(CASE WHEN r = 1 THEN id END) AS first_id, round(max(s), 6) AS similarity FROM similar_ GROUP BY 1")
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Requests for verification with the stored entities that are similar, most similar first."""
    asked, near = similars(spark, d)
    listed = near.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "similarity"))).alias("similar"))  # five a request
    j = asked.join(listed, "request_id")
    return j.select("request_id", F.col("name").alias("candidate_name"), F.size("similar").alias("n_similar"), F.col("similar")[0]["id"].alias("first_id"), F.round(F.col("similar")[0]["similarity"], 6).alias("similarity"))


@query("i5_latest_reviews", "SELECT user_id AS review_id, max(ts) AS at FROM events GROUP BY 1")
def i5(spark: SparkSession, d: str) -> DataFrame:
    q = T.table(spark, d, "events").select(F.col("user_id").alias("review_id"), F.col("ts").alias("at"), F.col("event_type").alias("action"))
    return X.latest_reviews(q).select("review_id", "at")


@query(
    "i6_first_auto_merge",
    """WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS said FROM events GROUP BY 1),
    scored AS (SELECT e.user_id AS new_id, event_id AS match_id, CASE WHEN value >= 90 THEN 'auto_merge' WHEN value <= 30 THEN 'auto_reject' ELSE 'human_review' END AS action FROM events e)
    SELECT s.new_id, min(match_id) AS match_id, (count(*) FILTER (WHERE action = 'human_review') > 0)::BOOLEAN AS was_reviewed FROM scored s JOIN last ON last.user_id = s.new_id
    WHERE action = 'auto_merge' OR (action = 'human_review' AND said = 'purchase') GROUP BY 1""",
)
def i6(spark: SparkSession, d: str) -> DataFrame:
    """The first match that is merged by itself or by the latest review of its node (here: users' events; a last purchase approves)."""
    from quillgraph.functions.matchers import decision

    e = T.table(spark, d, "events")
    reviews = X.latest_reviews(e.select(F.col("user_id").alias("review_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("action")))
    scored = e.select(F.col("user_id").alias("new_id"), F.col("event_id").alias("match_id"), decision(F.col("value") / 100).alias("action"))
    j = scored.join(reviews.select(F.col("review_id").alias("new_id"), (F.col("action") == "purchase").alias("approved")), "new_id")
    held = (F.col("action") == "auto_merge") | ((F.col("action") == "human_review") & F.col("approved"))
    return j.where(held).groupBy("new_id").agg(F.min("match_id").alias("match_id"), (F.count_if(F.col("action") == "human_review") > 0).alias("was_reviewed"))


@query("b21_rename_reembeds", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 9 = 0")
def b21(spark: SparkSession, d: str) -> DataFrame:
    """Only rows whose name changed are embedded again."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("old"))
    new = c.select("id", F.when(F.col("id") % 9 == 0, F.concat("old", F.lit("x"))).otherwise(F.col("old")).alias("new"))
    return c.join(new, "id").where(~F.col("old").eqNullSafe(F.col("new"))).select("id")
