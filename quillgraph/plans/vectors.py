"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import matchers as M
from quillgraph.functions import vector as V
from quillgraph.sources import tables as T

from .registry import query, with_views

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_SIM = "list_cosine_similarity(embedding::DOUBLE[], " + _Q + ")"
SIM0 = _SIM.format(0)


def items(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(spark: SparkSession, d: str, ident: int) -> list[float]:
    return items(spark, d).where(F.col("id") == ident).first()["vector"]


def _rounded(df: DataFrame, *also: str) -> DataFrame:
    return df.select("id", *also, F.round("similarity", 6).alias("similarity"))


@query("v1_entity_topk", f"SELECT vec_id AS id, round({SIM0}, 6) AS similarity FROM embeddings WHERE {SIM0} >= 0.3 ORDER BY {SIM0} DESC, vec_id LIMIT 10")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_k(items(spark, d), "vector", vector_of(spark, d, 0), 10, least=0.3))


@query("v2_statement_topk", f"SELECT vec_id AS id, round({_SIM.format(1)}, 6) AS similarity FROM embeddings ORDER BY {_SIM.format(1)} DESC, vec_id LIMIT 10")
def v2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_k(items(spark, d), "vector", vector_of(spark, d, 1), 10))


def text_items(spark: SparkSession, d: str, dims: int = 64) -> DataFrame:
    """Nations with the offline embedding of their names."""
    return T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), V.mock_embedding(F.col("n_name"), dims).alias("vector"))


_MOCK = "list_transform(range(0, 64), lambda i: sin((i + (list_sum(list_transform(string_split({0}, ''), lambda c: ascii(c)))::BIGINT % 65536))::DOUBLE) * 0.1)"


@query("v3_text_search", f"SELECT n_nationkey::BIGINT AS id, round(list_cosine_similarity({_MOCK.format('n_name')}, {_MOCK.format(repr('FRANCE'))}), 6) AS similarity FROM nation ORDER BY list_cosine_similarity({_MOCK.format('n_name')}, {_MOCK.format(repr('FRANCE'))}) DESC, 1 LIMIT 5")
def v3(spark: SparkSession, d: str) -> DataFrame:
    q = spark.range(1).select(V.mock_embedding(F.lit("FRANCE"), 64).alias("v")).first()["v"]
    return _rounded(V.top_k(text_items(spark, d), "vector", q, 5))


@query("v4_find_similar", f"SELECT vec_id AS id, label, round({_SIM.format(2)}, 6) AS similarity FROM embeddings ORDER BY {_SIM.format(2)} DESC, vec_id LIMIT 10")
def v4(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_k(items(spark, d), "vector", vector_of(spark, d, 2), 10), "label")


@query("v5_more_like_this", f"SELECT vec_id AS id, round({_SIM.format(3)}, 6) AS similarity FROM embeddings WHERE vec_id <> 3 ORDER BY {_SIM.format(3)} DESC, vec_id LIMIT 5")
def v5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_k(items(spark, d).where("id <> 3"), "vector", vector_of(spark, d, 3), 5))


@query("v6_content_similar", f"SELECT vec_id AS id, round(1 - {SIM0}, 6) AS distance, round({SIM0}, 6) AS similarity FROM embeddings WHERE 1 - {SIM0} < 0.8 ORDER BY 1 - {SIM0}, vec_id LIMIT 10")
def v6(spark: SparkSession, d: str) -> DataFrame:
    """The distance is bounded before the limit; both distance and similarity are returned."""
    out = V.top_k(items(spark, d), "vector", vector_of(spark, d, 0), 10, least=0.2 + 1e-12)
    return out.select("id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


_V7 = f"""hits AS (SELECT vec_id, row_number() OVER (ORDER BY {SIM0} DESC, vec_id) AS r FROM embeddings ORDER BY {SIM0} DESC, vec_id LIMIT 20),
 both_ends AS (SELECT entity_id AS id, r * 2 AS r FROM hits JOIN statements s ON s.id = vec_id * 4 UNION ALL SELECT object_entity_id, r * 2 + 1 FROM hits JOIN statements s ON s.id = vec_id * 4)"""


@query("v7_entities_by_statement", with_views("statements", also=_V7) + "SELECT id, min(r) AS first_rank FROM both_ends WHERE id IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def v7(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and objects of the 2k nearest statements, first seen first."""
    from pyspark.sql import Window

    hits = V.top_k(items(spark, d), "vector", vector_of(spark, d, 0), 20)  # at most 20 rows from here on
    hits = hits.withColumn("r", F.row_number().over(Window.orderBy("distance", "id"))).select((F.col("id") * 4).alias("id"), "r")
    s = T.statements(spark, d).select("id", "entity_id", "object_entity_id").join(F.broadcast(hits), "id")
    ends = s.select(F.explode(F.array(F.struct(F.col("entity_id").alias("id"), (F.col("r") * 2).alias("r")), F.struct(F.col("object_entity_id").alias("id"), (F.col("r") * 2 + 1).alias("r")))).alias("x")).select("x.*")
    return ends.where("id is not null").groupBy("id").agg(F.min("r").cast("long").alias("first_rank")).orderBy("first_rank", "id").limit(10)


@query(
    "v8_unified_search",
    f"""(SELECT 'entity' AS kind, vec_id AS id, round({SIM0}, 6) AS similarity FROM embeddings WHERE label < 5 AND {SIM0} >= 0.1 ORDER BY {SIM0} DESC, vec_id LIMIT 10)
    UNION ALL (SELECT 'statement', vec_id, round({SIM0}, 6) FROM embeddings WHERE label >= 5 ORDER BY {SIM0} DESC, vec_id LIMIT 10)
    UNION ALL (SELECT 'content', vec_id, round({SIM0}, 6) FROM embeddings WHERE label = 0 AND 1 - {SIM0} < 0.8 ORDER BY {SIM0} DESC, vec_id LIMIT 10)""",
)
def v8(spark: SparkSession, d: str) -> DataFrame:
    """One embedding of the query for all targets, each a top-k of its own."""
    q, x = vector_of(spark, d, 0), items(spark, d)
    parts = [
        ("entity", V.top_k(x.where("label < 5"), "vector", q, 10, least=0.1)),
        ("statement", V.top_k(x.where("label >= 5"), "vector", q, 10)),
        ("content", V.top_k(x.where("label = 0"), "vector", q, 10, least=0.2 + 1e-12)),
    ]
    out = [_rounded(df).select(F.lit(k).alias("kind"), "id", "similarity") for k, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "v9_label_topk",
    """SELECT query_id, id, round(s, 6) AS similarity, r AS rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id) AS r
    FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) >= 0.1) WHERE r <= 5""",
)
def v9(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest nodes of the same label; the queries are the rows whose id is divisible by 20, against all rows."""
    x = items(spark, d)
    out = V.nearest(x.where("id % 20 = 0"), x, 5, least=0.1, same_label=True)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("v10_cosine_guards", "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS self_reversed, 0.0::DOUBLE AS short, 0.0::DOUBLE AS missing FROM embeddings")
def v10(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    none = F.lit(None).cast("array<float>")
    return items(spark, d).select("id", F.round(V.cosine(v, F.reverse(v)), 6).alias("self_reversed"), V.cosine(v, F.slice(v, 1, 3)).alias("short"), V.cosine(v, none).alias("missing"))


@query("v11_similar_entities", f"SELECT vec_id AS id, round({_SIM.format(7)}, 6) AS similarity FROM embeddings ORDER BY {_SIM.format(7)} DESC, vec_id LIMIT 5")
def v11(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_k(items(spark, d), "vector", vector_of(spark, d, 7), 5))


@query("v12_near_text", f"SELECT vec_id AS id, round(({SIM0} + 1) / 2, 6) AS certainty FROM embeddings WHERE label = 1 AND ({SIM0} + 1) / 2 >= 0.5 ORDER BY {SIM0} DESC, vec_id LIMIT 3")
def v12(spark: SparkSession, d: str) -> DataFrame:
    """Certainty is the cosine scaled to [0, 1]."""
    out = V.top_k(items(spark, d).where("label = 1"), "vector", vector_of(spark, d, 0), 3, least=0.0)
    return out.select("id", F.round((F.col("similarity") + 1) / 2, 6).alias("certainty"))


_TYPES = ["Person", "Asset", "Address", "Event", "Other"]


@query("v13_type_thresholds", "SELECT vec_id AS id, CASE label % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.8 ELSE 0.8 END::DOUBLE AS threshold FROM embeddings")
def v13(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(t) for t in _TYPES]), F.pmod("label", F.lit(5)))
    return items(spark, d).select("id", M.threshold(kind).alias("threshold"))


@query("v15_mock_embedding", f"SELECT n_nationkey::BIGINT AS id, round(list_sum({_MOCK.format('n_name')}), 6) AS total, 64::INTEGER AS dims FROM nation")
def v15(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return text_items(spark, d).select("id", F.round(total, 6).alias("total"), F.size("vector").alias("dims"))


def recall(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Of how many of the k nearest of each query the index finds, and what share of the rows it compares in full for a query."""
    x = items(spark, d)
    q = x.where("id % 20 = 0")
    index = V.IVF(x)
    exact, found = V.nearest(q, x, k).select("query_id", "id"), index.search(q, k).select("query_id", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    read = index.candidates(q, index.WIDE * k).agg(F.count(F.lit(1)).alias("compared"))
    size = q.agg(F.count(F.lit(1)).alias("n_q")).crossJoin(x.agg(F.count(F.lit(1)).alias("n")))  # one row each
    return hits.crossJoin(read).crossJoin(size).select("recall", (F.col("compared") / (F.col("n_q") * F.col("n"))).alias("share"))


@query("v16_inverted_file")
def v16(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest by lists and product-quantised residuals; 200 rows a query, a tenth of all at most, are compared in full."""
    x = items(spark, d)
    return V.IVF(x).search(x.where("id % 20 = 0"), 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("v17_vector_index", "SELECT true AS recall_held, true AS tenth_read")
def v17(spark: SparkSession, d: str) -> DataFrame:
    """The index against exact search, as measured: a recall of 0.9 at least, from a tenth of the rows at most."""
    return recall(spark, d, 10).select((F.col("recall") >= 0.9).alias("recall_held"), (F.col("share") <= 0.1).alias("tenth_read"))


@query("v14_embedding_batches", "SELECT n_nationkey::BIGINT AS id, length(n_name)::DOUBLE AS first FROM nation")
def v14(spark: SparkSession, d: str) -> DataFrame:
    """A given embedder (here: the length of the text) in Arrow batches."""
    from quillgraph.operators import models

    e = models.embedding(F.col("n_name"), embedder=lambda texts: [[float(len(t))] for t in texts])
    return T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), e[0].alias("first"))
