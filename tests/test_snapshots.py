"""Versioned tables, transactions, the review queue and folded batches."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph import snapshots
from quillgraph.operators import resolve, reviews, state
from quillgraph.streaming import ingest

NODE = ingest.NODE


def nodes(spark, *rows):
    return spark.createDataFrame([(i, "P", n, p) for i, n, p in rows], NODE)


def upsert(tx, batch):
    tx.create("nodes", StructType.fromDDL(NODE), ["id"], 8)
    tx.change("nodes", batch, state.upsert_nodes)


def seen(df):
    return {r["id"]: (r["name"], r["props"]) for r in df.collect()}


def test_only_touched_buckets_are_written_and_old_versions_stay(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}")
    tx = store.begin()
    upsert(tx, nodes(spark, *[(f"n{i}", f"N{i}", {"k": str(i)}) for i in range(200)]))
    assert tx.commit() == 0
    before = store.manifest().tables["nodes"]["buckets"]
    tx = store.begin()
    upsert(tx, nodes(spark, ("n3", None, {"new": "x"})))
    assert tx.commit() == 1
    after = store.manifest().tables["nodes"]["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert seen(store.read("nodes"))["n3"] == ("N3", {"k": "3", "new": "x"}) and store.read("nodes").count() == 200
    assert seen(store.read("nodes", 0))["n3"] == ("N3", {"k": "3"})


def test_of_two_writers_of_the_same_rows_one_loses_cleanly(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}")
    first, second = store.begin(), store.begin()
    upsert(first, nodes(spark, ("a", "first", {})))
    upsert(second, nodes(spark, ("a", "second", {})))
    first.commit()
    with pytest.raises(snapshots.Conflict):
        second.commit()
    assert seen(store.read("nodes")) == {"a": ("first", {})} and store.log() == [0]
    assert not [d for d in os.listdir(tmp_path / "data") if d.startswith(second.id)]
    with pytest.raises(RuntimeError):
        second.commit()


def test_writers_of_other_buckets_both_succeed_but_not_after_reading_all(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}")
    tx = store.begin()
    upsert(tx, nodes(spark, *[(f"n{i}", "x", {}) for i in range(50)]))
    tx.commit()
    bucket = {r["id"]: r["b"] for r in store.read("nodes").select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    other = next(i for i in bucket if bucket[i] != bucket["n0"])
    a, b, reader = store.begin(), store.begin(), store.begin()
    n = reader.read("nodes").count()
    upsert(a, nodes(spark, ("n0", "a", {})))
    upsert(b, nodes(spark, (other, "b", {})))
    upsert(reader, nodes(spark, ("total", str(n), {})))
    assert [a.commit(), b.commit()] == [1, 2]
    got = seen(store.read("nodes"))
    assert got["n0"][0] == "a" and got[other][0] == "b"
    with pytest.raises(snapshots.Conflict):
        reader.commit()


def test_rollback_leaves_nothing(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}")
    tx = store.begin()
    upsert(tx, nodes(spark, ("a", "x", {})))
    tx.rollback()
    assert store.log() == [] and os.listdir(tmp_path / "data") == []


def test_streaming_survives_lost_and_half_written_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for k in range(3):
        ingest.commit(nodes(spark, (f"n{k}", "x", {"k": str(k)}), ("all", None, {f"p{k}": "y"})), k, folder)
    (tmp_path / "log" / "_draft").write_text('{"version": 3, "tab')  # a writer that died before it renamed
    ingest.commit(nodes(spark, ("n1", "again", {})), 1, folder)  # a replay
    want = {"n0": ("x", {"k": "0"}), "n1": ("x", {"k": "1"}), "n2": ("x", {"k": "2"}), "all": (None, {"p0": "y", "p1": "y", "p2": "y"})}
    assert seen(ingest.current(spark, folder)) == want
    for name in ("000000000002.json", ".000000000002.json.crc"):
        if os.path.exists(tmp_path / "log" / name):
            os.remove(tmp_path / "log" / name)  # the newest pointer is lost: the version before is in force
    ingest.commit(nodes(spark, ("n3", "x", {})), 3, folder)
    got = seen(ingest.current(spark, folder))
    assert {"n0", "n1", "n3", "all"} <= set(got) and got["all"][1] == {"p0": "y", "p1": "y"}


def test_batches_are_folded_in_a_stated_order(spark):
    old = nodes(spark, ("a", "A", {"p": "0", "z": "9"}))
    batch = nodes(spark, ("a", None, {"p": "1"}), ("a", "A2", {"q": "2"}), ("a", "A1", {"p": "3", "r": None}), ("b", None, None), (None, "x", {}))
    got = seen(state.upsert_nodes(old, batch))
    assert got == {"a": ("A2", {"z": "9", "p": "3", "q": "2", "r": None}), "b": (None, None)}
    timed = batch.withColumn("at", -F.monotonically_increasing_id())
    assert seen(state.upsert_nodes(old, timed))["a"] == ("A2", {"z": "9", "p": "1", "q": "2", "r": None})
    edge = "src string, dst string, type string, props map<string,string>"
    e = spark.createDataFrame([("a", "b", "T", {"w": "1"})], edge)
    new = spark.createDataFrame([("a", "b", "T", {"v": "2"}), ("a", "b", "T", {"v": "3", "u": "4"}), ("c", "d", "T", {"b": "1"}), ("c", "d", "T", {"a": "1"})], edge)
    assert {r["src"]: r["props"] for r in state.merge_edges(e, new).collect()} == {"a": {"w": "1", "v": "3", "u": "4"}, "c": {"a": "1", "b": "1"}}
    assert {r["src"]: r["props"] for r in state.insert_edges(e, new).collect()} == {"a": {"w": "1"}, "c": {"a": "1"}}


def test_reviews_are_asked_decided_and_read_by_the_cascade(spark, tmp_path):
    folder = f"file://{tmp_path}"
    make = lambda *rows: spark.createDataFrame([(i, "Asset", n, {"name": n}) for i, n in rows], NODE)
    old = make(("o1", "hydraulic lifting jack"), ("o2", "pneumatic riveting gun"))
    new = make(("n1", "hydraulic lifting jacks"), ("n2", "pneumatic riveting guns"), ("n3", "hydraulic lifting jackk"))
    pairs = resolve.fuzzy_pairs(new, old)
    reviews.ask(pairs, folder, "2024-01-01 00:00:00")
    reviews.ask(pairs, folder, "2024-01-02 00:00:00")  # they are in line already
    queue = reviews.queue(spark, folder)
    assert sorted((r["new_id"], r["match_id"]) for r in reviews.pending(queue).collect()) == [("n1", "o1"), ("n2", "o2"), ("n3", "o1")]
    said = spark.createDataFrame([("n1", "o1", "separate"), ("n1", "o1", "maybe"), ("n2", "o2", "separate")], "new_id string, match_id string, decision string")
    reviews.decide(said, folder, "2024-01-03 00:00:00")
    reviews.decide(said.where("new_id = 'n1'").withColumn("decision", F.lit("merge")).distinct(), folder, "2024-01-04 00:00:00")
    queue = reviews.queue(spark, folder)
    assert [r["new_id"] for r in reviews.pending(queue).collect()] == ["n3"]
    got = {r["new_id"]: (r["match_id"], r["stage"], r["action"]) for r in resolve.resolve(new, old, reviews=reviews.decisions(queue)).collect()}
    assert got == {"n1": ("o1", "fuzzy", "auto_merge"), "n2": ("n2", "create", "create"), "n3": ("o1", "fuzzy", "human_review")}
    first = {r["new_id"]: r["action"] for r in resolve.resolve(new, old, reviews=reviews.decisions(reviews.queue(spark, folder, 2))).collect()}
    assert first["n1"] == "create"  # as of an earlier version
