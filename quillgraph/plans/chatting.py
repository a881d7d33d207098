"""Typed plans over the graph model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources import tables as T

from . import chat as C
from .registry import query, with_views

ND = with_views("nodes", "edges")


@query("r1_intents", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'find' WHEN 1 THEN 'create' ELSE 'relate' END AS operation, CASE turn % 3 WHEN 0 THEN 'Part' WHEN 1 THEN 'Nation' ELSE 'Region' END AS entity_type FROM conversations")
def r1(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn")
    text = F.when(k % 3 == 0, F.concat(F.lit("show Part id "), "conv_id")).when(k % 3 == 1, F.concat(F.lit("create Nation N"), "conv_id")).otherwise("who PART_OF Region ASIA?")
    return T.table(spark, d, "conversations").select("conv_id", "turn", C.intents(text).alias("i")).select("conv_id", "turn", "i.operation", "i.entity_type")


@query("r2_command_grammar", "SELECT p_partkey, p_partkey::VARCHAR AS target_id, 'update' AS operation FROM part")
def r2(spark: SparkSession, d: str) -> DataFrame:
    i = C.intents(F.concat(F.lit("update Part id "), "p_partkey", F.lit(" p_brand New brand")))
    return T.table(spark, d, "part").select("p_partkey", i.alias("i")).select("p_partkey", "i.target_id", "i.operation")


def _run(spark: SparkSession, d: str, text: str) -> C.Outcome:
    intent = C.parse(text)
    assert intent is not None
    return C.execute(C.plan(intent), T.nodes(spark, d), T.edges(spark, d).withColumn("props", F.lit(None).cast("map<string,string>")))


@query("r3_read_plan", ND + "SELECT type, src AS id, name FROM edges JOIN nodes n ON n.id = src WHERE dst = (SELECT id FROM nodes WHERE name = 'ASIA') AND type = 'PART_OF'")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "who part_of Region ASIA?").rows


@query("r4_write_plan", "SELECT 'Part_' || p_partkey AS id, CASE p_partkey WHEN 5 THEN 'New brand' ELSE p_brand END AS brand FROM part")
def r4(spark: SparkSession, d: str) -> DataFrame:
    n = _run(spark, d, "update Part id 5 p_brand New brand").nodes
    return n.where("label = 'Part'").select("id", F.col("props")["p_brand"].alias("brand"))


@query("r5_execute_delete", ND + "SELECT id FROM nodes WHERE id <> 'Nation_3' AND label IN ('Nation', 'Region')")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "delete Nation id 3").nodes.where(F.col("label").isin("Nation", "Region")).select("id")


@query("r10_dated_pattern", "SELECT c_name, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def r10(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT c_name, o_orderkey FROM {o} JOIN {c} ON c_custkey = o_custkey WHERE o_orderdate BETWEEN CAST(:since AS TIMESTAMP) AND CAST(:until AS TIMESTAMP)"
    return spark.sql(sql, args={"since": "1995-01-01", "until": "1995-03-31"}, o=T.table(spark, d, "orders"), c=T.table(spark, d, "customer"))


@query("r11_update_by_id", "SELECT 'Part_5' AS id, 'x y' AS note")
def r11(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "update Part id 5 note x y").nodes.where("id = 'Part_5'").select("id", F.col("props")["note"].alias("note"))


@query("r7_answer", "SELECT 0::BIGINT AS at, 'done' AS line UNION ALL SELECT row_number() OVER (ORDER BY id), 'PART_OF ' || id || ' ' || name FROM (SELECT 'Nation_' || n_nationkey AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY 1 LIMIT 10) UNION ALL SELECT least(10, count(*)) + 1, 'Ask: show <Type> id <id>' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """The answer to a question over the graph, line by line: ten rows at most, with their ids, and what to ask next."""
    said = C.answer(_run(spark, d, "who PART_OF Region ASIA?"))
    return spark.createDataFrame([(n, t) for n, t in enumerate(said.splitlines())], "at long, line string")


@query("r8_engine_query", ND + "SELECT id, name FROM nodes WHERE id = 'Region_1'")
def r8(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.engine import Engine

    return Engine.over(spark, d).query("show Region id 1").select("id", "name")


def _stand_in(prompt: str) -> str:
    """Offline: says whether a text asks something. Of texts of odd length it forgets the kind at first, and never gets those of a length divisible by ten right."""
    import json

    text = json.loads(prompt.rsplit("\nText: ", 1)[1].split("\nAnswer:", 1)[0])
    answer = {"length": len(text), "kind": "question" if "?" in text else "statement"}
    if len(text) % 10 == 0:
        return "I would rather not say."
    if len(text) % 2 and "Problems:" not in prompt:
        del answer["kind"]
    return f"```json\n{json.dumps(answer)}\n```"


@query("r13_structured_output", "SELECT conv_id, turn, CASE WHEN length(text) % 10 <> 0 THEN CASE WHEN contains(text, '?') THEN 'question' ELSE 'statement' END END AS kind, CASE WHEN length(text) % 10 <> 0 THEN length(text) END::INTEGER AS length, CASE WHEN length(text) % 10 = 0 THEN 3 WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END::INTEGER AS asked, (length(text) % 10 = 0)::BOOLEAN AS failed FROM conversations")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """All turns through a model whose answers are checked, sent back and kept: equal texts are asked once."""
    from quillgraph.lineage import scratch
    from quillgraph.operators import structured

    schema = {"type": "object", "required": ["kind", "length"], "properties": {"kind": {"type": "string", "enum": ["question", "statement"]}, "length": {"type": "integer", "minimum": 0}}, "additionalProperties": False}
    request = structured.Request("Does the text ask something?", schema, [("Who is it?", {"kind": "question", "length": 10})])
    said = structured.answers(T.table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", request, _stand_in, scratch(spark))
    answer = F.from_json("answer", "kind string, length int")
    return said.select("conv_id", "turn", answer["kind"].alias("kind"), answer["length"].alias("length"), "asked", (F.size("problems") > 0).alias("failed"))
