import json

import pytest
from pyspark.sql import functions as F

from quillgraph.lineage import scratch
from quillgraph.functions import taxonomy
from quillgraph.operators import export, graph, state
from quillgraph.plans import chat
from quillgraph.sources import extraction
from quillgraph.streaming import ingest

NODE = "id string, label string, name string, props map<string,string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([("a", "P", "A & <a>", {"k": "1"}), ("b", "P", "B", None), ("c", "Q", None, {})], NODE)
    e = spark.createDataFrame([("a", "b", "t", {"w": "1"}), ("b", "c", "t", None), ("a", "b", "t", None), ("a", "zz", "t", None)], "src string, dst string, type string, props map<string,string>")
    return n, e


def test_upsert_is_idempotent(spark, small):
    n, _ = small
    batch = spark.createDataFrame([("a", "P", "A2", {"j": "2"}), ("d", "P", "D", {})], NODE)
    once = state.upsert_nodes(n, batch)
    assert rows(state.upsert_nodes(once, batch)) == rows(once)
    assert dict(once.where("id = 'a'").first()["props"]) == {"k": "1", "j": "2"}


def test_edges(spark, small):
    _, e = small
    base = e.dropDuplicates(state.EDGE)
    once = state.insert_edges(base, e)
    assert once.count() == base.count() and state.merge_edges(base, e).count() == base.count()
    assert tuple(state.insert_stats(base, e).first()) == (4, 0, 4)


def test_delete_takes_edges(spark, small):
    n, e = small
    n2, e2 = state.delete_nodes(n, e, spark.createDataFrame([("b",)], "id string"))
    assert [r["id"] for r in n2.orderBy("id").collect()] == ["a", "c"] and rows(e2.select("src", "dst")) == [("a", "zz")]


def test_merges(spark):
    ent = spark.createDataFrame([(k, f"e{k}", "pending") for k in range(1, 5)], "id long, name string, verification_status string")
    st = spark.createDataFrame(
        [(1, 1, "p", "x", "literal", None, 0.5), (2, 2, "p", "x", "literal", None, 0.9), (3, 2, "q", None, "entity", 3, 0.4), (4, 4, "r", None, "entity", 1, 0.2), (5, 2, "p", "x", "literal", None, 0.1)],
        "id long, entity_id long, predicate string, object string, object_type string, object_entity_id long, confidence double",
    ).withColumn("text", F.lit("t")).withColumn("content_id", F.lit(0))
    merges = spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")
    assert rows(state.follow(merges)) == [(1, 3), (2, 3)]
    state_after, after, audit = state.merge_into(ent, st, merges)
    assert rows(after.select("entity_id", "predicate", "object_entity_id", "confidence")) == [(3, "p", None, 0.9), (3, "q", 3, 0.4), (4, "r", 3, 0.2)]
    assert rows(state_after.select("id", "verification_status")) == [(1, "merged"), (2, "merged"), (3, "pending"), (4, "pending")]
    assert rows(audit) == [(1, 3, 1), (2, 3, 1)]  # moved ones only: two were folded
    again = state.merge_into(state_after, after, merges)[1]
    assert rows(again.select("entity_id", "predicate", "confidence")) == rows(after.select("entity_id", "predicate", "confidence"))
    renamed, both = state.merge_copy(ent, st, spark.createDataFrame([(1, 3)], "source_id long, target_id long"))
    assert renamed.where("id = 1").first()["name"] == "e1 (merged into e3)" and both.count() == 6


def test_merges_leave_equal_statements_of_others_alone(spark):
    ent = spark.createDataFrame([(k, f"e{k}", "pending") for k in range(1, 5)], "id long, name string, verification_status string")
    same = [(10, 3, 0.1), (11, 3, 0.2), (12, 2, 0.3), (13, 2, 0.2), (14, 1, 0.9), (15, 1, 0.4)]
    st = spark.createDataFrame([(i, e, "p", "x", "literal", None, c, f"t{i}", 0) for i, e, c in same] + [(16, 1, "q", None, "entity", 1, 0.5, "t16", 0), (17, 1, "q", None, "entity", 1, 0.7, "t17", 0)], "id long, entity_id long, predicate string, object string, object_type string, object_entity_id long, confidence double, text string, content_id int")
    _, after, audit = state.merge_into(ent, st, spark.createDataFrame([(1, 2)], "source_id long, target_id long"))
    got = rows(after.select("id", "entity_id", "object_entity_id", "confidence", "text"))
    assert got == [(10, 3, None, 0.1, "t10"), (11, 3, None, 0.2, "t11"), (12, 2, None, 0.9, "t12"), (13, 2, None, 0.2, "t13"), (16, 2, 2, 0.7, "t16")]
    assert rows(audit) == [(1, 2, 1)]


def test_cycle_of_merges(spark):
    m = spark.createDataFrame([(1, 2), (2, 1), (5, 5)], "source_id long, target_id long")
    assert rows(state.follow(m)) == [(2, 1)]


def test_hops_are_monotone(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "t") for k in range(6)] + [("n0", "n0", "t"), ("n3", "n0", "t")], "src string, dst string, type string")
    s = spark.createDataFrame([("n0",)], "id string")
    sets = [{r["node"] for r in graph.hops(e, s, k).collect()} for k in range(6)]
    assert sets[0] == set() and sets[1] == {"n1", "n3"} and all(a <= b for a, b in zip(sets, sets[1:])) and sets[5] == {f"n{k}" for k in range(1, 7)}
    nodes, net = graph.ego_network(e, s, 1)
    assert ("n0", "n0", "focus") in rows(nodes) and net.where("dst = 'n4'").isEmpty()


def test_exports_agree(spark, small, tmp_path):
    n, e = small
    lines = {k: [r["line"] for r in export.export(n, e, k).orderBy("part", "key").collect()] for k in export.FORMATS}
    links = [(x["source"], x["target"]) for x in (json.loads(v).get("link") for v in lines["json"]) if x]
    assert links == [("a", "b"), ("b", "c")] == [(x["data"]["source"], x["data"]["target"]) for x in map(json.loads, lines["cytoscape"]) if x["group"] == "edges"]
    import xml.etree.ElementTree as ET

    for kind in ("graphml", "gexf"):
        root = ET.fromstring("\n".join(lines[kind][1:]))
        assert [(x.get("source"), x.get("target")) for x in root.iter() if x.tag.endswith("}edge")] == links
    nodes, d3 = export.to_d3(*export.graph(n, e))
    assert rows(d3) == [(0, 1, "t"), (1, 2, "t")] and [r["index"] for r in nodes.orderBy("id").collect()] == [0, 1, 2]
    export.save(export.export(n, e, "gexf"), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.splitlines() == lines["gexf"]


def test_numbers_are_dense(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    got = [(r["k"], r["n"]) for r in export.numbered(df, "k", "n").collect()]
    assert sorted(got) == [(f"k{i:04d}", i) for i in range(1000)]


def test_extraction_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"extraction_result":{"entities":[{"type":"P","name":"x"},{"suggested_type":"Q","name":"y"}],"relationships":[]}}')
    (tmp_path / "sub" / "b.json").write_text('{"entities":[],"relationships":[{"type":"R","source":"x","target":"y","confidence":2}]}')
    (tmp_path / "bad.json").write_text("{nope")
    x = extraction.read(spark, str(tmp_path))
    assert x.count() == 2
    known, suggested = extraction.split_suggested(x)
    assert known.count() == suggested.count() == 1
    assert x.select(F.explode("relationships").alias("r")).select(extraction.relation_problems(F.col("r"))).first()[0] == ["confidence: not in 0..1"]
    files = extraction.attachments(spark, str(tmp_path), max_bytes=60)
    assert [r["kind"] for r in files.collect()] == ["text"]
    path = extraction.save_fixture(x.limit(1), str(tmp_path / "fx"))
    assert "/extraction_" in path and extraction.read(spark, path).count() == 1


def test_seed(spark, tmp_path):
    p = tmp_path / "s.yml"
    p.write_text("people:\n- {id: p1, labels: [Person], properties: {name: Ann, tags: [a]}}\nlinks:\n- {type: KNOWS, from: p1, to: [p2, p3]}\n")
    n, e = extraction.seed(spark, str(p))
    assert n.first()["label"] == "Person" and rows(e.select("src", "dst", "type")) == [("p1", "p2", "KNOWS"), ("p1", "p3", "KNOWS")]


def test_taxonomy(spark, tmp_path):
    f = taxonomy.frames(spark)
    assert f["types"].count() == 7 and f["rels"].where("symmetric").select("rel").distinct().count() == 3
    (tmp_path / "t.yml").write_text("Base:\n  core_properties:\n    name: {type: String, required: true}\nSub:\n  extends: Base\n  relations:\n    R: {to: [Base, Sub], cardinality: many}\nusage:\n  text: no type\n")
    own = taxonomy.load(spark, str(tmp_path))
    assert rows(own["types"]) == [("Base", None), ("Sub", "Base")] and own["rels"].count() == 2
    n = spark.createDataFrame([("1", "Sub", {"name": " "}), ("2", "Sub", {"name": "x"})], "id string, type string, props map<string,string>")
    assert rows(taxonomy.violations(n, own["types"], own["props"])) == [("1", "missing_required", "name")]
    assert "KNOWS -> Person (many)" in chat.taxonomy_context(f)


def test_chat(spark, small):
    n, e = small
    assert chat.parse("nonsense") is None and chat.parse("update P id a k").properties == {}
    run = lambda t: chat.execute(chat.plan(chat.parse(t)), n, e)
    assert run("update P id a k").message == "needs property, value"
    assert run("update P id nobody k v").message.startswith("nothing found")
    assert run("update P id a k 9").nodes.where("id = 'a'").first()["props"]["k"] == "9"
    assert run("create P Zed").nodes.where("name = 'Zed'").count() == 1
    assert rows(run("who t P B?").rows.select("id")) == [("a",), ("c",)]
    said = []
    answers = iter(["show P id a", "what?", "exit"])
    chat.repl(n, e, lambda _: next(answers), said.append)
    assert said[0].startswith("done") and said[1].startswith("Say that")


def test_streaming_ingestion(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "id string, name string, v string"

    def to_nodes(df):
        return df.select("id", F.lit("P").alias("label"), "name", F.create_map(F.lit("v"), F.col("v")).alias("props"))

    for k, line in enumerate(['{"id":"a","name":"A","v":"1"}', '{"id":"a","name":"A2","v":"2"}\n{"id":"b","name":"B","v":"3"}']):
        (src / f"{k}.json").write_text(line)
        ingest.ingest(spark, str(src), str(out), schema, to_nodes).awaitTermination()
    got = {r["id"]: (r["name"], r["props"]["v"]) for r in ingest.current(spark, str(out)).collect()}
    assert got == {"a": ("A2", "2"), "b": ("B", "3")}
    assert ingest.embed(ingest.current(spark, str(out)), 4).select(F.size("embedding")).first()[0] == 4


def test_models(spark, small):
    from quillgraph.engine import Engine
    from quillgraph.operators import models

    def fails(texts):
        raise OSError

    df = spark.createDataFrame([("ab",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(models.embedding(F.col("t"), embedder=fails)).collect()] == [None] * 3
    assert [r[0] for r in df.select(models.embedding(F.col("t"), embedder=lambda x: [[1.0]] * len(x))).collect()] == [[1.0], None, None]
    assert df.select(F.size(models.embedding(F.col("t"), 5))).first()[0] == 5
    left = [TimeoutError(), ConnectionError()]

    def busy(prompt):
        if left:
            raise left.pop()
        return prompt

    assert models.with_retry(busy, wait=0)("x") == "x"
    e = Engine(*small)
    assert e.query("show P id a").count() == 1 and e.query("delete P id a") is None
    assert e.run("delete P id a").startswith("done") and e.query("show P id a").isEmpty() and "who" in e.run("who")


def test_document_of_any_size_is_one_json_text(spark, tmp_path):
    """No limit on the size of the graph; the lines of the document, as saved, are one JSON text."""
    import json

    from quillgraph.operators import export

    ids = spark.range(3).selectExpr("concat('n', id) AS id", "concat('a \"b\" ', id) AS name", "'C' AS label", "map() AS props")
    links = spark.createDataFrame([("n0", "n1", "T"), ("n1", "n2", "T"), ("n0", "n9", "T")], "src string, dst string, type string")
    export.save(export.document(*export.graph(ids, links)), str(tmp_path / "doc"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert [(x["id"], x["name"], x["connections"]) for x in doc["nodes"]] == [("n0", 'a "b" 0', 1), ("n1", 'a "b" 1', 2), ("n2", 'a "b" 2', 1)]
    assert [(x["source"], x["target"]) for x in doc["links"]] == [("n0", "n1"), ("n1", "n2")] and not hasattr(export, "DOCUMENT_SIZE")
    none = export.document(*export.graph(ids.limit(0), links.limit(0))).orderBy("part").collect()
    assert json.loads("".join(r["line"] for r in none)) == {"nodes": [], "links": []}


def test_hundredths_and_serials_are_those_of_the_sql(spark):
    """Prices halfway between two hundredths of 500,000, and part keys of more than six digits."""
    import duckdb

    from quillgraph.plans import matching
    from quillgraph.sources.tables import hundredths

    want = duckdb.sql("SELECT x, round(x / 500000, 2) AS y FROM (SELECT (2500.0 + 5000 * r)::DOUBLE AS x FROM range(100) t(r))").fetchall()
    got = spark.createDataFrame([(x,) for x, _ in want], "x double").select("x", hundredths(F.col("x") / 500000)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    path = f"{scratch(spark)}"
    spark.range(1_199_990, 1_200_000).union(spark.range(119_995, 120_005)).selectExpr("id AS p_partkey").write.parquet(f"{path}/part.parquet")
    assert all(r["new_id"] == r["id"] for r in matching.f7(spark, path).collect()) and matching.f7(spark, path).count() == 20
