"""Mentions, triples, model answers, validation, and the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.lineage import scratch
from quillgraph.sources import extraction
from quillgraph.sources import tables as T

from .registry import query, with_views

_ASCII = "SELECT doc_id, regexp_replace(text, '(^|[^A-Za-z])([A-Z][a-z]{2,})', '\\1[\\2]', 'g') AS t FROM documents"
_MENTIONS = "list_distinct(regexp_extract_all(t, '\\[([^\\]]*)\\]', 1))"


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", X.annotate(F.col("text")).alias("t"))


@query("p1_mentions", f"SELECT doc_id, len({_MENTIONS})::INTEGER AS n, list_sort({_MENTIONS})[1] AS first FROM ({_ASCII})")
def p1(spark: SparkSession, d: str) -> DataFrame:
    m = X.mentions(F.col("t"))
    return annotated(spark, d).select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n"), F.get(F.sort_array("m"), F.lit(0)).alias("first"))


@query(
    "p2_mention_context",
    f"SELECT doc_id, m AS mention, trim(translate(substr(t, greatest(p - 100, 1), length(m) + 100 + p - greatest(p - 100, 1)), '[]', '')) AS context FROM (SELECT doc_id, t, m, instr(t, m) AS p FROM (SELECT doc_id, t, unnest({_MENTIONS}) AS m FROM ({_ASCII})))",
)
def p2(spark: SparkSession, d: str) -> DataFrame:
    """What stands around each mention of each document, where it first occurs."""
    m = annotated(spark, d).select("doc_id", "t", F.explode(X.mentions(F.col("t"))).alias("mention"))
    return m.select("doc_id", "mention", X.context(F.col("t"), F.col("mention")).alias("context"))


@query("p3_mentioned_in", f"SELECT name, count(*) AS n_contents, min(doc_id) AS first_content FROM (SELECT doc_id, unnest({_MENTIONS}) AS name FROM ({_ASCII})) GROUP BY 1")
def p3(spark: SparkSession, d: str) -> DataFrame:
    m = annotated(spark, d).select("doc_id", F.explode(X.mentions(F.col("t"))).alias("name"))
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n_contents"), F.min("doc_id").alias("first_content"))


@query(
    "p4_triples_from_text",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'is' WHEN 1 THEN 'contains' ELSE 'has attribute' END AS predicate,
    CASE p_partkey % 3 WHEN 2 THEN p_name || ' ' || p_type ELSE p_type END AS object, CASE p_partkey % 2 WHEN 0 THEN 'entity' ELSE 'literal' END AS object_type FROM part""",
)
def p4(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    verb = F.when(k % 3 == 0, " is ").when(k % 3 == 1, " contains ").otherwise(" ")
    predicate, rest, kind = X.triple_from_text(F.concat("p_name", verb, "p_type"), k % 2 == 0)
    return T.table(spark, d, "part").select("p_partkey", predicate.alias("predicate"), rest.alias("object"), kind.alias("object_type"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers made of events: fenced JSON, some with a bad statement, some no JSON."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"description":"e","statements":[{"text":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("t"), k)), F.lit('","predicate":"saw","object":"'), "event_type", F.lit('","confidence":'), (F.col("value") / 50).cast("string"), F.lit("}]}"))
    fenced = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 7 == 0, "no json").otherwise(body)
    return T.table(spark, d, "events").select("event_id", fenced.alias("answer"), "event_type", "value")


@query("p5_parse_answers", "SELECT event_id, NOT (event_id % 2 <> 0 AND event_id % 7 = 0) AS parsed FROM events")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("event_id", X.parse_response(F.col("answer"))["description"].isNotNull().alias("parsed"))


@query("p6_statement_problems", "SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN value / 50 > 1 OR value < 0 THEN 1 ELSE 0 END)::INTEGER AS n_problems FROM events WHERE NOT (event_id % 2 <> 0 AND event_id % 7 = 0)")
def p6(spark: SparkSession, d: str) -> DataFrame:
    s = answers(spark, d).select("event_id", F.explode(X.parse_response(F.col("answer"))["statements"]).alias("s"))
    return s.select("event_id", F.size(X.statement_problems(F.col("s"))).alias("n_problems"))


@query("p7_statement_defaults", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'saw ' || event_type ELSE 't' || event_id END AS text, 'literal' AS object_type, 'ai' AS source FROM events WHERE NOT (event_id % 2 <> 0 AND event_id % 7 = 0)")
def p7(spark: SparkSession, d: str) -> DataFrame:
    s = answers(spark, d).select("event_id", F.explode(X.parse_response(F.col("answer"))["statements"]).alias("s"))
    return s.select("event_id", X.with_defaults(F.col("s")).alias("s")).select("event_id", "s.text", "s.object_type", "s.source")


@query("p15_signatures", "SELECT 'Part:' || p_name || ':' || p_partkey AS signature FROM part")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select(X.signature(F.lit("Part"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("signature"))


@query("p18_property_diff", "SELECT 'Part_' || p_partkey AS id, 'p_brand' AS property, p_brand AS old, 'New' AS new FROM part WHERE p_brand <> 'New' UNION ALL SELECT 'Part_' || p_partkey, 'p_type', p_type, NULL FROM part")
def p18(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d).where("label = 'Part'").withColumn("new", F.create_map(F.lit("p_brand"), F.lit("New")))
    keys = F.array_union(F.map_keys("props"), F.map_keys("new"))
    x = n.select("id", "props", "new", F.explode(keys).alias("property"))
    return x.select("id", "property", F.col("props")[F.col("property")].alias("old"), F.col("new")[F.col("property")].alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


@query("p19_string_operations", "SELECT p_partkey, lower(p_name) AS low, trim('  ' || p_name || ' ') AS stripped, CASE WHEN length(p_type) > 8 THEN substr(p_type, 1, 5) || '...' ELSE p_type END AS short, regexp_replace(p_name || '  x', ' +', ' ', 'g') AS squeezed, string_split(p_name, ' ')[1] AS first, replace(p_brand, '#', '-') AS replaced FROM part")
def p19(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    short = X.truncate(F.col("p_type"), 8)
    return T.table(spark, d, "part").select("p_partkey", F.lower(n).alias("low"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("stripped"), short.alias("short"), F.regexp_replace(F.concat(n, F.lit("  x")), " +", " ").alias("squeezed"), F.split_part(n, F.lit(" "), F.lit(1)).alias("first"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("replaced"))


@query("p20_math", "SELECT event_id, round(sqrt(value), 6) AS root, least(1.0, greatest(0.0, value / 50)) AS clamped, round(sin(value), 6) + 0.0 AS sine FROM events")
def p20(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return T.table(spark, d, "events").select("event_id", F.round(F.sqrt(v), 6).alias("root"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 50)).alias("clamped"), (F.round(F.sin(v), 6) + 0.0).alias("sine"))


@query("p21_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("p22_name_fallback", "SELECT 'Region_' || r_regionkey AS id, coalesce(nullif(r_name, 'ASIA'), 'Region_' || r_regionkey) AS name FROM region")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(spark, d).where("label = 'Region'").select("id", F.coalesce(F.nullif("name", F.lit("ASIA")), F.col("props")["title"], F.col("id")).alias("name"))


@query("p23_durations", "SELECT event_id, CASE WHEN value < 50 THEN round(value)::BIGINT || 'ms' ELSE printf('%.2fs', floor(value) / 10) END AS took FROM events")
def p23(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return T.table(spark, d, "events").select("event_id", F.when(v < 50, X.format_duration(v)).otherwise(F.concat(F.format_number(F.floor(v) / 10, 2), F.lit("s"))).alias("took"))


@query("p24_entity_mentions", "SELECT n_nationkey, n_name AS first, 2::INTEGER AS n FROM nation")
def p24(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("See [Entity: "), "n_name", F.lit(" ] and [Entity:other] and [plain] and [Entity: "), "n_name", F.lit("]"))
    m = X.entity_mentions(t)
    return T.table(spark, d, "nation").select("n_nationkey", F.get(m, F.lit(0)).alias("first"), F.size(m).alias("n"))


@query("p26_annotated_from_entities", with_views("entities") + "SELECT content_id, 'This content contains: ' || string_agg('[' || name || ']', ' ' ORDER BY name, id) || ' ' AS text FROM entities GROUP BY 1")
def p26(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d).groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("name", "id"))).alias("e"))
    names = F.array_join(F.transform("e", lambda x: F.concat(F.lit("["), x["name"], F.lit("]"))), " ")
    return e.select("content_id", F.concat(F.lit("This content contains: "), names, F.lit(" ")).alias("text"))


@query("p27_link_defaults", with_views("edges") + "SELECT src, dst, CASE type WHEN 'PART_OF' THEN 'related_to' ELSE type END AS type, 1::INTEGER AS value FROM edges WHERE type <> 'SUPPLIED_BY'")
def p27(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d).where("type <> 'SUPPLIED_BY'").withColumn("type", F.nullif("type", F.lit("PART_OF")))
    return e.select("src", "dst", F.coalesce("type", F.lit("related_to")).alias("type"), F.lit(1).alias("value"))


@query("p25_property_display", "SELECT p_partkey, 'p_brand: ' || p_brand || '; p_type: ' || p_type AS shown FROM part")
def p25(spark: SparkSession, d: str) -> DataFrame:
    n = T.nodes(spark, d).where("label = 'Part'")
    e = F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: v.isNotNull() & (v != ""))))
    shown = F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "; ")
    return n.select(F.split_part("id", F.lit("_"), F.lit(2)).cast("long").alias("p_partkey"), shown.alias("shown"))


# ---- Extraction documents ------------------------------------------------------------------------


@query("p8_extraction_problems", "SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::INTEGER AS n_problems FROM events")
def p8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = F.struct(F.when(k % 3 != 0, "Person").alias("type"), F.lit("p1").alias("id"), F.lit("Ann").alias("name"), F.when(k % 4 == 0, 1.5).otherwise(0.5).alias("confidence"))
    return T.table(spark, d, "events").select("event_id", F.size(extraction.entity_problems(e)).alias("n_problems"))


@query("p9_extraction_precheck", "SELECT event_id, event_id % 2 = 0 AS ready FROM events")
def p9(spark: SparkSession, d: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 2 == 0, '{"extraction_result":{"entities":[{"type":"Person","name":"A"}],"relationships":[]}}').otherwise('{"entities":[],"relationships":[]}')
    x = T.table(spark, d, "events").select("event_id", extraction.parse(doc).alias("x"))
    return x.select("event_id", extraction.ready(F.col("x")).alias("ready"))


@query("p16_unwrap_envelope", "SELECT event_id, event_id % 2 = 0 AS wrapped, 'A' AS name FROM events")
def p16(spark: SparkSession, d: str) -> DataFrame:
    inner = '{"entities":[{"type":"Person","name":"A"}],"relationships":[]}'
    doc = F.when(F.col("event_id") % 2 == 0, '{"extraction_result":' + inner + "}").otherwise(inner)
    return T.table(spark, d, "events").select("event_id", doc.contains("extraction_result").alias("wrapped"), extraction.parse(doc)["entities"][0]["name"].alias("name"))


_P17 = """says AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'nation_' || (conv_id % 40) WHEN 1 THEN 'NATION_' || (turn % 25) WHEN 2 THEN '' ELSE 'Speaker ' || role END AS subject FROM conversations),
 known AS (SELECT lower(n_name) AS key, min(n_nationkey) AS id FROM nation GROUP BY 1),
 told AS (SELECT conv_id, turn, subject, k.id, subject = '' AS wrong, k.id IS NULL AND subject <> '' AND subject LIKE 'Speaker%' AS made FROM says LEFT JOIN known k ON lower(subject) = k.key)"""


@query("p17_analysis_outcome", f"WITH {_P17} SELECT conv_id, CASE WHEN count(*) FILTER (WHERE wrong) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE id IS NULL AND NOT made AND NOT wrong) > 0 THEN 'partial' ELSE 'complete' END AS status, count(*) FILTER (WHERE id IS NOT NULL OR made) AS stored, count(*) FILTER (WHERE id IS NULL AND NOT made AND NOT wrong) AS pending, count(*) FILTER (WHERE wrong) AS errors, count(DISTINCT CASE WHEN made THEN subject END) AS created FROM told GROUP BY 1")
def p17(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a content (here: turns) find their subject by name, ignoring case, or have it created where its type
    is allowed to be (here: speakers); others wait for verification, and those without a subject are errors."""
    t = F.col("turn") % 4
    subject = F.when(t == 0, F.concat(F.lit("nation_"), F.col("conv_id") % 40)).when(t == 1, F.concat(F.lit("NATION_"), F.col("turn") % 25)).when(t == 2, "").otherwise(F.concat(F.lit("Speaker "), "role"))
    said = T.table(spark, d, "conversations").select("conv_id", subject.alias("subject"), subject.startswith("Speaker").alias("may_create"))
    return outcome(said, T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


def outcome(said: DataFrame, known: DataFrame) -> DataFrame:
    """conv_id, status, stored, pending, errors, created of statements (conv_id, subject, may_create) against entities (id, name)."""
    by_name = known.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    j = said.withColumn("key", F.lower("subject")).join(by_name, "key", "left")
    wrong = ~F.coalesce(F.trim("subject") != "", F.lit(False))
    found, made = F.col("id").isNotNull(), F.col("id").isNull() & ~wrong & F.col("may_create")
    counts = j.groupBy("conv_id").agg(F.count_if(found | made).alias("stored"), F.count_if(~found & ~made & ~wrong).alias("pending"), F.count_if(wrong).alias("errors"), F.countDistinct(F.when(made, F.col("subject"))).alias("created"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("pending") > 0, "partial").otherwise("complete")
    return counts.select("conv_id", status.alias("status"), "stored", "pending", "errors", "created")


@query("a13_data_urls", "SELECT n_nationkey, 'image/png' AS mime, n_name AS decoded FROM nation")
def a13(spark: SparkSession, d: str) -> DataFrame:
    mime, data = X.data_url(F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("n_name").cast("binary"))))
    return T.table(spark, d, "nation").select("n_nationkey", mime.alias("mime"), data.cast("string").alias("decoded"))


@query("d6_embedding_text", "SELECT 'Part_' || p_partkey AS id, p_name || '. ' || p_type AS text FROM part")
def d6(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.functions.matchers import embedding_text

    p = F.create_map(F.lit("name"), F.col("p_name"), F.lit("title"), F.lit(" "), F.lit("description"), F.col("p_type"))
    return T.table(spark, d, "part").select(F.concat(F.lit("Part_"), "p_partkey").alias("id"), embedding_text("Note", p).alias("text"))


@query("d7_normalise_extraction", "SELECT p_partkey, p_name AS name FROM part")
def d7(spark: SparkSession, d: str) -> DataFrame:
    e = F.struct(F.lit("Part").alias("type"), F.lit(None).cast("string").alias("name"), F.create_map(F.lit("name"), F.col("p_name")).alias("properties"))
    return T.table(spark, d, "part").select("p_partkey", extraction.entity_name(e).alias("name"))


@query("d8_aliases", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 2 ELSE 1 END::INTEGER AS n FROM customer")
def d8(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" II")))
    return T.table(spark, d, "customer").select("c_custkey", F.size(X.aliases(F.col("c_name"), other, F.col("c_name"), F.lit(" "))).alias("n"))


@query("d10_property_formatter", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, props AS nested FROM events")
def d10(spark: SparkSession, d: str) -> DataFrame:
    nested = F.to_json(F.from_json("props", "map<string,int>"))
    return T.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.regexp_replace(nested, ":", ": ").alias("nested"))


@query("a8_read_extractions", "SELECT event_type AS kind, count(*) AS n_files, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_entities, min(event_id)::VARCHAR AS first FROM events GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    """A folder of JSON lines with an extraction of every event, half of them in an envelope, written and read back with its subfolders."""
    k = F.col("event_id").cast("string")
    inner = F.concat(F.lit('{"name":"'), k, F.lit('","entities":'), F.when(F.col("event_id") % 2 == 0, F.lit('[{"type":"P","name":"x"}]')).otherwise("[]"), F.lit(',"relationships":[]}'))
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"extraction_result":'), inner, F.lit("}"))).otherwise(inner)
    path = scratch(spark)
    T.table(spark, d, "events").select(F.concat(F.lit('{"kind":"'), "event_type", F.lit('","key":"'), k, F.lit('","body":'), F.to_json(F.struct(doc.alias("b"))).substr(F.lit(6), F.length(F.to_json(F.struct(doc.alias("b")))) - 6), F.lit("}")).alias("value"), F.col("event_type").alias("folder")).write.partitionBy("folder").text(path)
    read = spark.read.option("recursiveFileLookup", "true").schema("kind string, key string, body string").json(path)
    x = read.select("kind", "key", extraction.parse(F.col("body")).alias("x"))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size("x.entities")).alias("n_entities"), F.min(F.col("key").cast("long")).cast("string").alias("first"))


@query("a11_attachments")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder up to the size limit."""
    return extraction.attachments(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "kind")


@query("a14_fixture_name", "SELECT event_id, 'extraction_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || substr(md5(props), 1, 8) AS name FROM events")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.concat(F.lit("extraction_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.md5("props"), 1, 8)).alias("name"))
