"""String similarity, matching rules, confidence and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import matchers as M
from quillgraph.functions import strings as S
from quillgraph.lineage import cut, scratch
from quillgraph.operators import fuzzy, resolve, reviews
from quillgraph.sources import tables as T

from .registry import query, with_views

_SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein(lower({0}), lower({1}))::DOUBLE / greatest(length({0}), length({1})) END"
_TRI = "(CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END)"


@query("f1_string_similar", "SELECT p_partkey, " + _SIM.format("p_name", "p_type") + " >= 0.2 - 1e-12 OR p_name = p_type AS alike FROM part")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", S.similar(F.col("p_name"), F.col("p_type"), 0.2).alias("alike"))


@query("f2_similarity_score", "SELECT p_partkey, round(" + _SIM.format("p_name", "p_brand") + ", 6) AS score FROM part")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.round(S.score_or_zero(F.col("p_name"), F.col("p_brand")), 6).alias("score"))


@query("f3_review_similarity", "SELECT p_partkey, round(" + _SIM.format("p_brand", "p_type") + ", 6) AS score FROM part")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.round(S.similarity(F.col("p_brand"), F.col("p_type")), 6).alias("score"))


def _jaccard(a: str, b: str) -> str:
    x, y = _TRI.format(a), _TRI.format(b)
    return f"(len(list_intersect({x}, {y}))::DOUBLE / greatest(1, len(list_distinct(list_concat({x}, {y})))))"


@query("f4_trigram_jaccard", "SELECT p_partkey, round(" + _jaccard("p_name", "p_type") + ", 6) AS score FROM part")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.round(S.trigram_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("score"))


def like_names(spark: SparkSession, d: str, least: float = 0.8) -> fuzzy.LikeNames:
    """All entities, by name."""
    return fuzzy.LikeNames(T.entities(spark, d).select("id", "name"), least)


_LIKE = f"""named AS (SELECT lower(name) AS name, min(id) AS rep, count(DISTINCT id) AS n FROM entities GROUP BY 1),
 tri AS (SELECT name, rep, n, {_TRI.format("name")} AS t FROM named),
 same AS (SELECT rep AS ra, rep AS rb, 1.0::DOUBLE AS score, n AS n_a, n AS n_b FROM named WHERE n > 1 AND length(name) >= 3),
 pairs AS (SELECT * FROM (SELECT a.rep AS ra, b.rep AS rb, a.n AS n_a, b.n AS n_b, len(list_intersect(a.t, b.t)) AS both_, len(a.t) + len(b.t) AS all_
   FROM tri a JOIN tri b ON a.rep < b.rep AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t)) WHERE both_ / greatest(1, all_ - both_) > 0.8),
 liked AS (SELECT ra, rb, both_ / (all_ - both_) AS score, n_a, n_b FROM pairs UNION ALL SELECT * FROM same),
 members AS (SELECT e.id, rep FROM entities e JOIN named ON lower(e.name) = named.name),
 firsts AS (SELECT id, rep FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY id) AS r FROM members) WHERE r <= 11),
 expanded AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, score FROM liked JOIN firsts x ON x.rep = ra JOIN firsts y ON y.rep = rb WHERE ra <> rb OR x.id < y.id)"""


@query("e11_like_pairs", with_views("entities", also=_LIKE) + "SELECT ra AS a, rb AS b, round(score, 6) AS score, n_a, n_b FROM liked")
def e11(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of entities with like names, as pairs of names with the ids that have each; a = b: the ids that share a name."""
    like = like_names(spark, d)
    n = like.names.select("rep", "n")
    different = like.pairs.join(n.withColumnsRenamed({"rep": "ra", "n": "n_a"}), "ra").join(n.withColumnsRenamed({"rep": "rb", "n": "n_b"}), "rb")
    same = like.shared.select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("score"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return different.unionByName(same).select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.round("score", 6).alias("score"), "n_a", "n_b")


@query("m5_top_duplicates", with_views("entities", also=_LIKE) + "SELECT a, b, round(score, 6) AS score FROM expanded ORDER BY expanded.score DESC, a, b LIMIT 10")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return like_names(spark, d).top(10).select("a", "b", F.round("score", 6).alias("score"))


_REPORT = with_views("entities", "statements", also=_LIKE + ", per AS (SELECT entity_id, count(*) AS n FROM statements GROUP BY 1)")
_REPORTED = "SELECT a, b, round(score, 2) AS score, coalesce(p.n, 0) AS n_a, coalesce(q.n, 0) AS n_b FROM expanded LEFT JOIN per p ON p.entity_id = a LEFT JOIN per q ON q.entity_id = b ORDER BY expanded.score DESC, a, b LIMIT 10"


def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar pairs and the statements of both sides."""
    top = cut(like_names(spark, d).top(10))  # the report shows ten; counts are looked up for these
    wanted = top.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    per = T.statements(spark, d).join(F.broadcast(wanted), "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    out = top.join(per.withColumnsRenamed({"entity_id": "a", "n": "n_a"}), "a", "left").join(per.withColumnsRenamed({"entity_id": "b", "n": "n_b"}), "b", "left")
    return out.select("a", "b", F.round("score", 2).alias("score"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


@query("f5_duplicate_report", _REPORT + _REPORTED)
def f5(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_report(spark, d)


@query("b2_duplicate_csv", _REPORT + f"SELECT a || ',' || b || ',' || printf('%.2f', score) || ',' || n_a || ',' || n_b AS line FROM ({_REPORTED})")
def b2(spark: SparkSession, d: str) -> DataFrame:
    """The duplicate report as lines of CSV."""
    r = duplicate_report(spark, d)
    return r.select(F.to_csv(F.struct("a", "b", F.format_number("score", 2), "n_a", "n_b")).alias("line"))


_ASKED = [("Red Widget", "Part"), ("blue unheard of", "Part"), ("FRANCE", "Nation"), ("nation_1", "Nation"), ("idge t", "Part"), ("ustom er", "Customer"), ("upplie rs", "Part"), ("zzz", "Part")]
_F6 = f"""q AS (SELECT unnest({[n for n, _ in _ASKED]}) AS name, unnest({[k for _, k in _ASKED]}) AS label),
exact AS (SELECT q.name, q.label, e.id FROM q JOIN entities e ON lower(e.name) = lower(q.name) AND e.kind = q.label),
part_ AS (SELECT q.name, q.label, e.id FROM q JOIN entities e ON contains(lower(e.name), string_split(lower(q.name), ' ')[1]) AND e.kind = q.label WHERE length(q.name) > 3 AND q.name NOT IN (SELECT name FROM exact)),
both_ AS (SELECT *, 'exact' AS how FROM exact UNION ALL SELECT *, 'word' FROM part_)"""


@query("f6_name_candidates", with_views("entities", also=_F6) + "SELECT name, label, id, how FROM (SELECT *, row_number() OVER (PARTITION BY name, label ORDER BY id) AS r FROM both_) WHERE r <= 10")
def f6(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(_ASKED, "name string, label string")
    return fuzzy.name_candidates(asked, T.entities(spark, d).withColumnRenamed("kind", "label"))


def _keyed(spark: SparkSession, d: str, upper: bool) -> DataFrame:
    serial = F.concat(F.lit("sn-" if upper else "SN "), F.format_string("%06d", F.col("p_partkey")))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("serial_number"), serial, F.lit("email"), F.concat(F.lit("P"), F.col("p_partkey"), F.lit("@Mail.com"))).alias("props"))


@query("f7_serial_lookup", "SELECT p_partkey AS new_id, p_partkey AS id FROM part")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.key_candidates(_keyed(spark, d, True), _keyed(spark, d, False), "serial_number", S.alnum_upper)


@query("f7_email_lookup", "SELECT p_partkey AS new_id, p_partkey AS id FROM part")
def f7b(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.key_candidates(_keyed(spark, d, True), _keyed(spark, d, False), "email", lambda c: F.lower(F.trim(c)))


@query("f8_any_name_word", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')")
def f8(spark: SparkSession, d: str) -> DataFrame:
    n = F.lower("p_name")
    return T.table(spark, d, "part").where(n.contains("red") | n.contains("ring")).select(F.col("p_partkey").alias("id"))


# ---- H: rules over derived pairs -----------------------------------------------------------------


def _map(**kw) -> F.Column:
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v if not isinstance(v, str) else F.expr(v))])


def person_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = "cast(c_custkey as string)"
    a = _map(full_name="concat('Ann ', c_name)", email=f"concat('c', {k}, '@m', cast(c_custkey % 4 as string), '.com')", phone=f"concat('555-010', cast(c_custkey % 10 as string), '-', {k})")
    b = _map(
        full_name="case c_custkey % 3 when 0 then concat('Ann ', c_name) when 1 then concat('Anne ', c_name) else concat('Bob Supplier#', c_custkey) end",
        email=f"case c_custkey % 2 when 0 then upper(concat('c', {k}, '@m', cast(c_custkey % 4 as string), '.com')) else concat('x', {k}, '@m', cast(c_custkey % 3 as string), '.com') end",
        phone=f"concat('+1 (555) 010', cast(c_custkey % 10 as string), ' ', cast(c_custkey + c_custkey % 5 as string))",
    )
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), a.alias("a"), b.alias("b"))


_PERSON = """p AS (SELECT c_custkey AS id, 'Ann ' || c_name AS na, CASE c_custkey % 3 WHEN 0 THEN 'Ann ' || c_name WHEN 1 THEN 'Anne ' || c_name ELSE 'Bob Supplier#' || c_custkey END AS nb,
 'c' || c_custkey || '@m' || (c_custkey % 4) || '.com' AS ea, CASE c_custkey % 2 WHEN 0 THEN upper('c' || c_custkey || '@m' || (c_custkey % 4) || '.com') ELSE 'x' || c_custkey || '@m' || (c_custkey % 3) || '.com' END AS eb,
 '555010' || (c_custkey % 10) || c_custkey AS pa, '1555010' || (c_custkey % 10) || (c_custkey + c_custkey % 5) AS pb FROM customer)"""
_NAMES = _SIM.format("na", "nb")


def _rule(pairs: DataFrame, rule: M.Rule) -> DataFrame:
    return pairs.select("id", rule(F.col("a"), F.col("b")).alias("matched"))


@query("h2_exact_email", f"WITH {_PERSON} SELECT id, lower(ea) = lower(eb) AS matched FROM p")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return _rule(person_pairs(spark, d), M.same("email"))


@query("h3_phone", f"WITH {_PERSON} SELECT id, least(length(pa), length(pb)) >= 8 AND (contains(pa, pb) OR contains(pb, pa)) AS matched FROM p")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return _rule(person_pairs(spark, d), M.phone)


@query("h4_domain_and_name", f"WITH {_PERSON} SELECT id, split_part(lower(ea), '@', 2) = split_part(lower(eb), '@', 2) AND {_NAMES} >= 0.8 - 1e-12 AS matched FROM p")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return _rule(person_pairs(spark, d), M.domain_and_name)


@query("h5_full_name", f"WITH {_PERSON} SELECT id, {_NAMES} >= 0.9 - 1e-12 AS matched FROM p")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return _rule(person_pairs(spark, d), M.person_name)


_LAST = _SIM.format("split_part(na, ' ', 2)", "split_part(nb, ' ', 2)")


@query("h6_last_name_and_initial", f"WITH {_PERSON} SELECT id, {_LAST} >= 0.9 - 1e-12 AND lower(na[1]) = lower(nb[1]) AS matched FROM p")
def h6(spark: SparkSession, d: str) -> DataFrame:
    return _rule(person_pairs(spark, d), M.last_name_and_initial)


@query("h7_full_name_of", "SELECT c_custkey AS id, 'Ann ' || c_name AS full_name FROM customer")
def h7(spark: SparkSession, d: str) -> DataFrame:
    m = _map(first_name="'Ann'", last_name="c_name")
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.full_name(m).alias("full_name"))


def asset_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _map(name="p_name", brand="p_brand", model="p_type", serial_number="concat('SN-', p_partkey)", vin="concat('V-', p_partkey)")
    b = _map(
        name="case p_partkey % 3 when 0 then concat(p_name, 's') else 'other thing' end",
        brand="case p_partkey % 4 when 0 then 'Zenith' else p_brand end",
        model="case p_partkey % 5 when 0 then 'Zodiac' else p_type end",
        serial_number="case p_partkey % 2 when 0 then concat('sn-', p_partkey) else concat('X', p_partkey) end",
        vin="case p_partkey % 7 when 0 then concat('v', p_partkey) else concat('W', p_partkey) end",
    )
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))


@query("h1_default_name", "SELECT p_partkey AS id, " + _SIM.format("p_name", "(CASE p_partkey % 3 WHEN 0 THEN p_name || 's' ELSE 'other thing' END)") + " >= 0.9 - 1e-12 AS matched FROM part")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return _rule(asset_pairs(spark, d), M.default_name)


@query("h8_serial_number", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS matched FROM part")
def h8(spark: SparkSession, d: str) -> DataFrame:
    return _rule(asset_pairs(spark, d), M.same("serial_number"))


@query("h9_unique_identifier", "SELECT p_partkey AS id, p_partkey % 7 = 0 AS matched FROM part")
def h9(spark: SparkSession, d: str) -> DataFrame:
    return _rule(asset_pairs(spark, d), M.unique_identifier)


_BRANDS = _SIM.format("p_brand", "(CASE p_partkey % 4 WHEN 0 THEN 'Zenith' ELSE p_brand END)")
_MODELS = _SIM.format("p_type", "(CASE p_partkey % 5 WHEN 0 THEN 'Zodiac' ELSE p_type END)")


@query("h10_brand_and_model", f"SELECT p_partkey AS id, {_BRANDS} >= 0.8 - 1e-12 AND {_MODELS} >= 0.7 - 1e-12 AS matched FROM part")
def h10(spark: SparkSession, d: str) -> DataFrame:
    return _rule(asset_pairs(spark, d), M.brand_and_model)


@query("h11_asset_name", "SELECT p_partkey AS id, " + _SIM.format("p_name", "(CASE p_partkey % 3 WHEN 0 THEN p_name || 's' ELSE 'other thing' END)") + " >= 0.85 - 1e-12 AS matched FROM part")
def h11(spark: SparkSession, d: str) -> DataFrame:
    return _rule(asset_pairs(spark, d), M.asset_name)


@query("h12_extract_brand", "SELECT p_partkey AS id, upper(p_brand) AS brand FROM part")
def h12(spark: SparkSession, d: str) -> DataFrame:
    return asset_pairs(spark, d).select("id", M.brand(F.col("a")).alias("brand"))


@query("h13_extract_model", "SELECT p_partkey AS id, CASE WHEN length(split_part(p_name, ' ', 2)) > 0 THEN split_part(p_name, ' ', 2) END AS model FROM part")
def h13(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.model(_map(name="p_name")).alias("model"))


def address_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = "cast(s_suppkey as string)"
    a = _map(street=f"concat({k}, ' North Main Street')", city="'New York City'", state="'New York'", postalCode="'10001-1234'", country="'United States'")
    b = _map(
        street=f"case s_suppkey % 3 when 0 then concat({k}, ' N. Main St.') when 1 then concat({k}, ' N Mayn St') else concat('9', {k}, ' Elm Blvd') end",
        city="case s_suppkey % 2 when 0 then 'NYC' else 'Albany' end",
        state="'ny'",
        postalCode="case s_suppkey % 5 when 0 then '10001' else '20002' end",
        country="'usa'",
    )
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), a.alias("a"), b.alias("b"))


_STREETS = "(s_suppkey || ' n main st')", "(CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' n main st' WHEN 1 THEN s_suppkey || ' n mayn st' ELSE '9' || s_suppkey || ' elm blvd' END)"
_ADDRESSES = f"({_STREETS[0]} || ', new york ny 10001, usa')", f"({_STREETS[1]} || CASE s_suppkey % 2 WHEN 0 THEN ', new york ny ' ELSE ', albany ny ' END || CASE s_suppkey % 5 WHEN 0 THEN '10001' ELSE '20002' END || ', usa')"


@query("h14_normalized_address", f"SELECT s_suppkey AS id, s_suppkey % 3 <> 2 AND ({_SIM.format(*_ADDRESSES)} >= 0.85 - 1e-12 OR contains({_ADDRESSES[0]}, {_ADDRESSES[1]}) OR contains({_ADDRESSES[1]}, {_ADDRESSES[0]})) AS matched FROM supplier")
def h14(spark: SparkSession, d: str) -> DataFrame:
    return _rule(address_pairs(spark, d), M.normalized_address)


@query("h15_street", "SELECT s_suppkey AS id, s_suppkey % 3 IN (0, 1) AS matched FROM supplier")
def h15(spark: SparkSession, d: str) -> DataFrame:
    return _rule(address_pairs(spark, d), M.street)


@query("h16_city_state_zip", "SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS matched FROM supplier")
def h16(spark: SparkSession, d: str) -> DataFrame:
    return _rule(address_pairs(spark, d), M.city_state_zip)


@query("h17_coordinates", "SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS near FROM supplier")
def h17(spark: SparkSession, d: str) -> DataFrame:
    a, b = _map(latitude="'40.0'", longitude="'-73.0'"), _map(latitude="case s_suppkey % 2 when 0 then '40.0005' else '41.0' end", longitude="'-73.0'")
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), M.coordinates(a, b).alias("near"))


@query("h18_normalize_street", "SELECT s_suppkey AS id, s_suppkey || ' n main st' AS street FROM supplier")
def h18(spark: SparkSession, d: str) -> DataFrame:
    return address_pairs(spark, d).select("id", S.normalize_street(F.col("a")["street"]).alias("street"))


@query("h19_normalize_city", "SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'new york' ELSE 'albany' END AS city FROM supplier")
def h19(spark: SparkSession, d: str) -> DataFrame:
    return address_pairs(spark, d).select("id", S.normalize_city(F.col("b")["city"]).alias("city"))


@query("h20_normalize_state", "SELECT s_suppkey AS id, 'NY' AS state FROM supplier")
def h20(spark: SparkSession, d: str) -> DataFrame:
    return address_pairs(spark, d).select("id", S.normalize_state(F.col("a")["state"]).alias("state"))


@query("h21_normalize_country", "SELECT s_suppkey AS id, 'usa' AS country FROM supplier")
def h21(spark: SparkSession, d: str) -> DataFrame:
    return address_pairs(spark, d).select("id", S.normalize_country(F.col("a")["country"]).alias("country"))


@query("h22_normalize_address", "SELECT s_suppkey AS id, s_suppkey || ' n main st, new york ny 10001, usa' AS address FROM supplier")
def h22(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return address_pairs(spark, d).select("id", S.normalize_address(a["street"], a["city"], a["state"], a["postalCode"], a["country"]).alias("address"))


@query("h23_street_components", "SELECT s_suppkey AS id, s_suppkey::VARCHAR AS number, 'n main st' AS name FROM supplier")
def h23(spark: SparkSession, d: str) -> DataFrame:
    s = S.normalize_street(F.col("a")["street"])
    return address_pairs(spark, d).select("id", S.street_number(s).alias("number"), S.street_name(s).alias("name"))


def _bits(key: Column, n: int = 128) -> Column:
    """A vector of n signs, from the MD5 of a key: those of different keys are far from each other."""
    h = F.md5(key.cast("string"))
    nibble = lambda i: F.instr(F.lit("0123456789abcdef"), F.substr(h, (F.floor(i / 4) + 1).cast("int"), F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(nibble(i) / F.pow(F.lit(2.0), i % 4)) % 2 * 2 - 1).cast("double"))


def _props(*pairs) -> Column:
    return F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in pairs for x in kv]), lambda k, v: v.isNotNull())


def incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All parts as nodes, and a batch of one node for each: by its key modulo 7 the same id, an old node's serial number,
    an old node's bar code under another name, a name with a letter more, nothing known, an old node's
    embedding under another name, or (of a label without rules) equal properties. Names are hashes, far from each other."""
    k = F.col("p_partkey")
    kind = k % 7
    number = F.concat(F.lit("unit "), F.substring(F.md5(k.cast("string")), 1, 16))
    mark = _props(("kind", F.md5(k.cast("string"))))
    old = _props(("name", number), ("serial_number", F.concat(F.lit("SN-"), k)), ("barcode", F.concat(F.lit("b/"), k)))
    label = F.when(kind == 6, "Thing").otherwise("Asset").alias("label")
    p = T.table(spark, d, "part")
    existing = p.select(F.concat(F.lit("Part_"), k).alias("id"), label, F.when(kind != 6, number).alias("name"), F.when(kind == 6, mark).otherwise(old).alias("props"), F.when(kind != 6, _bits(k)).alias("embedding"))
    name = F.concat(F.lit("thing "), F.substring(F.md5(F.concat(k, F.lit("new"))), 1, 16))
    serial, code = F.when(kind == 1, F.concat(F.lit(" sn-"), k)), F.when(kind == 2, F.concat(F.lit("B "), k))
    props = _props(("name", F.when(kind == 3, F.concat(number, F.lit("x"))).otherwise(name)), ("serial_number", serial), ("barcode", code))
    ident = F.when(kind == 0, F.concat(F.lit("Part_"), k)).otherwise(F.concat(F.lit("New_"), k))
    new = p.select(ident.alias("id"), label, F.when(kind == 6, mark).otherwise(props).alias("props"), F.when(kind == 5, _bits(k)).alias("embedding"))
    return new.withColumn("name", F.col("props")["name"]), existing


_NEW = "CASE p_partkey % 7 WHEN 0 THEN 'Part_' ELSE 'New_' END || p_partkey"
_CASE = "CASE p_partkey % 7 {} END"


@query(
    "h24_resolution_cascade",
    f"SELECT {_NEW} AS new_id, " + _CASE.format("WHEN 0 THEN 'constraint' WHEN 4 THEN 'create' WHEN 5 THEN 'vector' WHEN 6 THEN 'equality' ELSE 'fuzzy'") + " AS stage, CASE p_partkey % 7 WHEN 4 THEN 'New_' ELSE 'Part_' END || p_partkey AS match_id, " + _CASE.format("WHEN 3 THEN 'human_review' WHEN 4 THEN 'create' ELSE 'auto_merge'") + " AS action FROM part",
)
def h24(spark: SparkSession, d: str) -> DataFrame:
    """Every stage of the cascade over all parts, of all labels."""
    return resolve.resolve(*incoming(spark, d), with_vectors=True).select("new_id", "stage", "match_id", "action")


@query("e10_blocked_matching", f"SELECT {_NEW} AS new_id, 'Part_' || p_partkey AS match_id, " + _CASE.format("WHEN 3 THEN 'human_review' ELSE 'auto_merge'") + " AS action FROM part WHERE p_partkey % 7 IN (1, 2, 3)")
def e10(spark: SparkSession, d: str) -> DataFrame:
    new, old = incoming(spark, d)
    return resolve.fuzzy_stage(new, old).select("new_id", "match_id", "action")


@query(
    "k10_import_stats",
    "SELECT CASE p_partkey % 7 WHEN 6 THEN 'Thing' ELSE 'Asset' END AS label, count(*) AS total, count(*) FILTER (WHERE p_partkey % 7 = 4) AS created, count(*) FILTER (WHERE p_partkey % 7 IN (1, 2, 5)) AS updated, count(*) FILTER (WHERE p_partkey % 7 IN (0, 6)) AS skipped, count(*) FILTER (WHERE p_partkey % 7 = 3) AS reviewed, 0::BIGINT AS duplicates, 0::BIGINT AS errors FROM part GROUP BY 1 "
    "UNION ALL SELECT 'Copy', 2 * count(*), count(*), 0, 0, 0, count(*), 0 FROM part UNION ALL SELECT NULL, count(*), 0, 0, 0, 0, 0, count(*) FROM part WHERE p_partkey % 9 = 0",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    """What became of a batch: nodes that change nothing are skipped, doubtful ones are counted as reviews, copies within the batch as duplicates and nodes without a label as errors."""
    new, old = incoming(spark, d)
    same = old.join(new.select("id"), "id", "left_semi")
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    twice = p.select(k, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c"))
    copies = twice.select(F.concat(F.lit("Copy_"), k, F.lit("_"), "c").alias("id"), F.lit("Copy").alias("label"), _props(("tag", F.md5(F.concat(k, F.lit("copy"))))).alias("props"), F.lit(None).cast("array<double>").alias("embedding"), F.concat(F.when(F.col("c") == "a", "COPY ").otherwise("copy "), k).alias("name"))
    wrong = p.where(k % 9 == 0).select(F.concat(F.lit("Wrong_"), k).alias("id"), F.lit(None).cast("string").alias("label"), _props(("name", F.concat(F.lit("w"), k))).alias("props"), F.lit(None).cast("array<double>").alias("embedding"), F.concat(F.lit("w"), k).alias("name"))
    batch = new.join(same.select("id"), "id", "left_anti").unionByName(same).unionByName(copies).unionByName(wrong)
    return resolve.import_stats(resolve.resolve(batch, old, with_vectors=True), batch, old)


def chains(spark: SparkSession, d: str) -> DataFrame:
    """A batch of a node for each part: in blocks of ten each shares a serial number or a VIN with the next, and nothing with the one after."""
    k, at = F.col("p_partkey"), F.col("p_partkey") % 10
    block = F.floor(k / 10)
    props = _props(("name", F.substring(F.md5(k.cast("string")), 1, 20)), ("serial_number", F.concat(F.lit("s"), block, F.lit("-"), F.floor(at / 2))), ("vin", F.concat(F.lit("v"), block, F.lit("-"), F.floor((at + 1) / 2))))
    return T.table(spark, d, "part").select(F.concat(F.lit("New_"), F.lpad(k.cast("string"), 12, "0")).alias("id"), F.lit("Vehicle").alias("label"), props["name"].alias("name"), props.alias("props"))


@query("h25_batch_closure", "SELECT 'New_' || lpad(p_partkey::VARCHAR, 12, '0') AS new_id, 'New_' || lpad((min(p_partkey) OVER (PARTITION BY p_partkey // 10))::VARCHAR, 12, '0') AS match_id, CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_partkey // 10) THEN 'create' ELSE 'batch' END AS stage FROM part")
def h25(spark: SparkSession, d: str) -> DataFrame:
    """A batch into an empty graph: what chains by fuzzy matches becomes one node, whatever the order of the batch."""
    new = chains(spark, d)
    return resolve.resolve(new, new.limit(0)).select("new_id", "match_id", "stage")


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The batch, the stored nodes, and a review queue: all doubtful pairs are in line, two of three are decided, some of them twice."""
    new, old = (cut(x.drop("embedding")) for x in incoming(spark, d))
    folder = scratch(spark)
    reviews.ask(resolve.fuzzy_pairs(new, old), folder, "2024-01-01 00:00:00")
    line = reviews.pending(reviews.queue(spark, folder)).withColumn("k", F.regexp_extract("new_id", r"(\d+)$", 1).cast("long"))
    first = line.where("k % 3 < 2").withColumn("decision", F.when(F.col("k") % 3 == 0, "merge").otherwise("separate"))
    reviews.decide(first, folder, "2024-01-02 00:00:00")
    reviews.decide(first.where("k % 5 = 0").withColumn("decision", F.when(F.col("k") % 3 == 0, "separate").otherwise("merge")), folder, "2024-01-03 00:00:00")
    return new, old, reviews.queue(spark, folder)


_SAID = "CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN (p_partkey % 3 = 0) = (p_partkey % 5 <> 0) THEN 'merge' ELSE 'separate' END"


@query("i5_review_queue", f"SELECT 'New_' || p_partkey AS new_id, 'Part_' || p_partkey AS match_id, {_SAID} AS decision, {_SAID} IS NULL AS pending, CASE WHEN p_partkey % 3 = 2 THEN 1 WHEN p_partkey % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS n_rows FROM part WHERE p_partkey % 7 = 3")
def i5q(spark: SparkSession, d: str) -> DataFrame:
    """The state of the queue: each pair in line, its newest decision, and whether it waits still."""
    q = _reviewed(spark, d)[2]
    of = ["new_id", "match_id"]
    rows = q.groupBy(*of).agg(F.count(F.lit(1)).alias("n_rows"))
    waits = reviews.pending(q).select(*of, F.lit(True).alias("waits"))
    return rows.join(reviews.decisions(q), of, "left").join(waits, of, "left").select(*of, "decision", F.coalesce("waits", F.lit(False)).alias("pending"), "n_rows")


@query("i6_reviewed_cascade", f"SELECT new_id, CASE WHEN said = 'separate' OR kind = 4 THEN new_id ELSE 'Part_' || k END AS match_id, CASE WHEN said = 'separate' OR kind = 4 THEN 'create' WHEN kind = 3 AND said IS NULL THEN 'human_review' ELSE 'auto_merge' END AS action FROM (SELECT {_NEW} AS new_id, p_partkey AS k, p_partkey % 7 AS kind, CASE p_partkey % 7 WHEN 3 THEN {_SAID} END AS said FROM part WHERE p_partkey % 7 <> 5)")
def i6q(spark: SparkSession, d: str) -> DataFrame:
    """The cascade with the decisions of the queue: a pair that was merged is taken, one that was separated is not, one that waits stays in review."""
    new, old, q = _reviewed(spark, d)
    known = new.where(F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 7 != 5, F.lit(True)))  # those are found by their embeddings alone
    return resolve.resolve(known, old, reviews=reviews.decisions(q)).select("new_id", "match_id", "action")


@query("h28_extended_thresholds", with_views("nodes") + "SELECT id, CASE label WHEN 'Customer' THEN 0.80 WHEN 'Supplier' THEN 0.82 WHEN 'Part' THEN 0.83 WHEN 'Nation' THEN 0.80 ELSE 0.8 END::DOUBLE AS threshold FROM nodes")
def h28(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of every node, its label taken as one of the further types."""
    kinds = dict(zip(["Customer", "Supplier", "Part", "Nation"], M.EXTENDED_THRESHOLDS))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return T.nodes(spark, d).select("id", M.threshold(kind[F.col("label")]).alias("threshold"))


# ---- I: confidence -------------------------------------------------------------------------------


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with what holds and the confidence, each step over the columns of the one before."""
    a, b = F.col("a"), F.col("b")
    x = asset_pairs(spark, d).select("id", M.prepare(a).alias("a"), M.prepare(b).alias("b"))
    x = x.withColumn("rules", M.fired("Asset", a, b))
    return x.select("id", "rules", M.confidence("Asset", a, b, F.col("rules")).alias("confidence"))


_I_NAME = _SIM.format("p_name", "(CASE p_partkey % 3 WHEN 0 THEN p_name || 's' ELSE 'other thing' END)")
_I = f"""s AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS serial, p_partkey % 7 = 0 AS ident, {_BRANDS} AS br, {_MODELS} AS mo, {_I_NAME} AS na FROM part),
h AS (SELECT *, br >= 0.8 - 1e-12 AND mo >= 0.7 - 1e-12 AS bm, na >= 0.85 - 1e-12 AS nm FROM s),
w AS (SELECT id, CASE WHEN serial THEN 1.0 ELSE 0.0 END + CASE WHEN ident THEN 0.95 ELSE 0.0 END + CASE WHEN bm THEN 0.7 ELSE 0.0 END + CASE WHEN nm THEN 0.5 ELSE 0.0 END AS weight,
 CASE WHEN serial THEN 1.0 ELSE 0.0 END + CASE WHEN ident THEN 0.95 ELSE 0.0 END + CASE WHEN bm THEN 0.7 * (greatest(br, 0.3) + greatest(mo, 0.4)) / 2 ELSE 0.0 END + CASE WHEN nm THEN 0.5 * 0.8 * na ELSE 0.0 END AS total FROM h),
c AS (SELECT id, CASE WHEN weight > 0 THEN greatest(0.0, least(1.0, total / weight + 0.1)) ELSE 0.0 END AS confidence FROM w)"""


@query("i1_confidence", f"WITH {_I} SELECT id, round(confidence::DOUBLE, 6) AS confidence FROM c")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", F.round("confidence", 6).alias("confidence"))


@query("i4_decision", f"WITH {_I} SELECT id, CASE WHEN confidence >= 0.9 THEN 'auto_merge' WHEN confidence <= 0.3 THEN 'auto_reject' ELSE 'human_review' END AS action FROM c")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", M.decision(F.col("confidence")).alias("action"))


@query("i2_rule_scores", f"SELECT p_partkey AS id, 1.0::DOUBLE AS serial_number, 1.0::DOUBLE AS unique_identifier, round((greatest({_BRANDS}, 0.3) + greatest({_MODELS}, 0.4)) / 2, 6)::DOUBLE AS brand_and_model, round(0.8 * {_I_NAME}, 6)::DOUBLE AS name FROM part")
def i2(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return asset_pairs(spark, d).select("id", *[F.round(M.rule_score(k, a, b), 6).alias(k) for k in M.ASSET])


@query(
    "i3_confidence_modifiers",
    "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.85 END::DOUBLE AS confidence FROM part",
)
def i3(spark: SparkSession, d: str) -> DataFrame:
    """Equal serial numbers (1.0): with much else known on both sides (+0.1, at most 1), with nothing else (-0.2), with a generic name (-0.15)."""
    k = F.col("p_partkey")
    serial = F.concat(F.lit("SN-"), k)
    rich = F.create_map(F.lit("serial_number"), serial, F.lit("vin"), F.concat(F.lit("V"), k), F.lit("barcode"), F.concat(F.lit("B"), k))
    bare, generic = F.create_map(F.lit("serial_number"), serial), F.create_map(F.lit("serial_number"), serial, F.lit("name"), F.lit("Truck"))
    other = F.create_map(F.lit("serial_number"), serial, F.lit("name"), F.lit("unlike it"))
    a = F.when(k % 3 == 0, rich).when(k % 3 == 1, bare).otherwise(generic)
    b = F.when(k % 3 == 0, F.map_filter(rich, lambda x, _: x != "vin")).when(k % 3 == 1, bare).otherwise(other)
    b = F.when(k % 3 == 0, F.map_concat(b, F.create_map(F.lit("part_number"), F.concat(F.lit("P"), k)))).otherwise(b)
    x = T.table(spark, d, "part").select(k.alias("id"), M.prepare(a).alias("a"), M.prepare(b).alias("b"))
    rules = F.array_remove(F.array_remove(M.fired("Asset", F.col("a"), F.col("b")), "unique_identifier"), "brand_and_model")
    return x.select("id", F.round(M.confidence("Asset", F.col("a"), F.col("b"), rules), 6).alias("confidence"))


@query("h26_arbiter", f"WITH {_I} SELECT id AS new_id, CASE WHEN confidence >= 0.9 THEN id END AS match_id FROM c")
def h26(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import models

    return models.arbitrate(asset_pairs(spark, d).select(F.col("id").alias("new_id"), "id", "a", "b"), "Asset")


@query("h27_relation_typing", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'reverse_component' ELSE 'none' END AS kind, 0.5::DOUBLE AS confidence FROM part")
def h27(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import models

    longer = "case p_partkey % 3 when {} then concat(p_name, ' wheel') when {} then p_name else 'zzz' end"
    a, b = _map(name=longer.format(1, 0)), _map(name=longer.format(0, 1))
    kind = models.relation(a, b, F.lit(0.5))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("r")).select("id", "r.kind", "r.confidence")


@query("n5_trigram_sets", "SELECT p_partkey, len(" + _TRI.format("p_name") + ")::INTEGER AS n FROM part")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.size(S.trigrams(F.col("p_name"))).alias("n"))
