"""State changes as pure functions: snapshot in, batch in, snapshot out.

All are idempotent where the operation is: running a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both; the new value wins. Needs no session setting: old keys that the new map has are left out first."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


# ---- Nodes: id, label, name, props ----------------------------------------------------------------


def folded(batch: DataFrame, key: list[str], *single: str) -> DataFrame:
    """One row for each key of a batch: of each property, and of each single column, the last value that is given.

    The order is that of the column `at`, if there is one, and then of the values themselves; nulls
    give nothing, but a property that is null in all rows stays null. Properties are counted one by
    one before the shuffle, so a key that has many rows of the batch is no group in one task.
    """
    at = F.col("at") if "at" in batch.columns else F.lit(0)
    rows = batch.select(*key, *single, at.alias("at"), "props")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("at", c))).alias(c) for c in single]
    heads = rows.groupBy(*key).agg(*last, F.max(F.col("props").isNotNull()).alias("has"))
    each = rows.select(*key, "at", F.explode("props").alias("k", "v"))
    each = each.groupBy(*key, "k").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("at", "v"))).alias("v"))
    maps = each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))  # a row has these properties
    out = heads.join(maps, key, "left")
    none = F.create_map().cast("map<string,string>")
    return out.select(*key, *single, F.coalesce("props", F.when(F.col("has"), none)).alias("props"))


def upsert_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert by id, or update: new properties win, others stay. An id that a batch has twice is folded first; a null id is left out."""
    b = folded(batch.where("id is not null"), ["id"], "label", "name").withColumnsRenamed({"label": "l", "name": "m", "props": "p"})
    j = nodes.join(b, "id", "full_outer")
    return j.select("id", F.coalesce("l", "label").alias("label"), F.coalesce("m", "name").alias("name"), merge_maps(F.col("props"), F.col("p")).alias("props"))


def upsert_by_key(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """key, k, props, created of objects (key, k: a sortable id, props) after a batch is upserted by the unique key.

    An object of the batch goes into the stored one of its key: new properties win, the lowest stored id stays.
    A key that is not stored is made under the lowest id of the batch. Rows of one key are folded on both sides; null keys are left out.
    """
    old, new = (folded(df.where("key is not null"), ["key"]).join(df.groupBy("key").agg(F.min("k").alias("k")), "key") for df in (stored, batch))
    j = old.join(new.withColumnsRenamed({"k": "k_new", "props": "p_new"}), "key", "full_outer")
    return j.select("key", F.coalesce("k", "k_new").alias("k"), merge_maps(F.col("props"), F.col("p_new")).alias("props"), F.col("k").isNull().alias("created"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone (id) and every edge at them."""
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(*edges.columns)


# ---- Edges: src, dst, type, props -----------------------------------------------------------------

EDGE = ["src", "dst", "type"]


def merge_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type); properties of the batch win, folded where it has an edge twice."""
    b = folded(batch, EDGE).withColumnRenamed("props", "p")
    return edges.join(b, EDGE, "full_outer").select(*EDGE, merge_maps(F.col("props"), F.col("p")).alias("props"))


def insert_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """New edges only; one that exists keeps its properties, and one that the batch has twice the first (by `at`, then as text)."""
    at = F.col("at") if "at" in batch.columns else F.lit(0)
    text = F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props")))), F.lit(""))
    first = batch.groupBy(*EDGE).agg(F.min_by("props", F.struct(at, text)).alias("props"))
    return edges.unionByName(first.join(edges.select(*EDGE), EDGE, "left_anti").select(*edges.columns))


def insert_stats(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """What insert_edges would do, without doing it: total, created, skipped."""
    known = batch.join(edges.select(*EDGE).distinct().withColumn("known", F.lit(True)), EDGE, "left").groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    fresh = F.when(F.col("known").isNull(), 1).otherwise(0)
    return known.agg(F.sum("n").alias("total"), F.sum(fresh).alias("created"), (F.sum("n") - F.sum(fresh)).alias("skipped"))


def evolve(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the missing columns are added, as nulls of their type."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in df.columns])


# ---- Entities and statements ----------------------------------------------------------------------

STATEMENT_KEY = ["entity_id", "predicate", "object", "object_type", "object_entity_id"]


def follow(merges: DataFrame) -> DataFrame:
    """source_id to the entity at the end of its chain of merges (A to B to C gives A to C); a cycle ends at its smallest id.

    Each round doubles the length that is followed; the loop ends when nothing moves.
    """
    ids = cut(merges.where("source_id <> target_id").groupBy("source_id").agg(F.min("target_id").alias("target_id")))
    for _ in range(40):
        step = ids.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("next"))
        moved = cut(ids.join(step, "target_id", "left").select("source_id", F.when(F.col("next") == F.col("source_id"), F.least("source_id", "target_id")).otherwise(F.coalesce("next", "target_id")).alias("target_id")))
        same = moved.join(ids, ["source_id", "target_id"], "left_anti").isEmpty()
        ids = moved
        if same:
            break
    return ids.where("source_id <> target_id")


def merge_into(entities: DataFrame, statements: DataFrame, merges: DataFrame, followed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, statements and audit rows after merges (source_id, target_id).

    A source's statement moves to the target, unless the target has an equal one (null-safe, with references as
    they were before the merges): then it is folded into that, which keeps its id and takes the higher
    confidence. Equal ones that move together are folded into the one of the lowest id. References to a source
    follow it to the target. Nothing else changes: equal statements that an entity had itself stay, of a
    target too. Sources get the status merged; the audit counts the statements that moved, not those that were folded.
    followed: the merges have no chains, so that no id map has to be followed.
    """
    ids = cut(merges if followed else follow(merges))
    subject, other = ids.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("s_to")), ids.select(F.col("source_id").alias("object_entity_id"), F.col("target_id").alias("o_to"))
    # The columns that a statement keeps when it moves; the rest is its key.
    own = [c for c in statements.columns if c not in STATEMENT_KEY]
    marked = statements.join(subject, "entity_id", "left").withColumn("moves", F.col("s_to").isNotNull())
    stay = marked.where("not moves").select(*statements.columns)
    goal = ids.select(F.col("target_id").alias("entity_id")).distinct()
    met = marked.where("moves").withColumn("from", F.col("entity_id")).withColumn("entity_id", F.col("s_to")).unionByName(stay.join(goal, "entity_id", "left_semi").withColumn("moves", F.lit(False)), allowMissingColumns=True)
    row = F.struct("moves", *[F.col(c) for c in ["id", "from", *[c for c in own if c != "id"]]])
    kept = met.groupBy(*STATEMENT_KEY).agg(F.min_by(row, F.struct("moves", "id")).alias("k"), F.max(F.when(F.col("moves"), F.col("confidence"))).alias("most"), F.count_if("moves").alias("n")).where("n > 0")
    kept = cut(kept.select(*[c for c in STATEMENT_KEY], "k.*", "most"))
    raised = kept.where("not moves").select("id", "most")
    stay = stay.join(raised, "id", "left").withColumn("confidence", F.greatest("confidence", "most")).select(*statements.columns)
    moved = kept.where("moves").withColumn("confidence", F.greatest("confidence", "most"))
    after = stay.unionByName(moved.select(*statements.columns)).join(other, "object_entity_id", "left")
    after = after.withColumn("object_entity_id", F.coalesce("o_to", "object_entity_id")).select(*statements.columns)
    state = entities.join(ids.select(F.col("source_id").alias("id"), F.lit("merged").alias("to")), "id", "left")
    state = state.withColumn("verification_status", F.coalesce("to", "verification_status")).select(*entities.columns)
    audit = ids.join(moved.groupBy(F.col("from").alias("source_id")).agg(F.count(F.lit(1)).alias("n")), "source_id", "left")
    return state, after, audit.select("source_id", "target_id", F.coalesce("n", F.lit(0)).alias("transferred"))


def merge_copy(entities: DataFrame, statements: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The other merge: statements of the source are copied (copy_of is their id), references follow, the source is renamed."""
    names = entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    ids = merges.join(names, "target_id")
    copies = statements.join(ids.select(F.col("source_id").alias("entity_id"), F.col("target_id")), "entity_id").withColumn("copy_of", F.col("id")).withColumn("entity_id", F.col("target_id"))
    both = statements.withColumn("copy_of", F.lit(None).cast("long")).unionByName(copies.select(*statements.columns, "copy_of"))
    both = both.join(merges.select(F.col("source_id").alias("object_entity_id"), F.col("target_id").alias("o_to")), "object_entity_id", "left")
    both = both.withColumn("object_entity_id", F.coalesce("o_to", "object_entity_id")).select(*statements.columns, "copy_of")
    renamed = entities.join(ids.select(F.col("source_id").alias("id"), "target_name"), "id", "left")
    name = F.when(F.col("target_name").isNotNull(), F.concat("name", F.lit(" (merged into "), "target_name", F.lit(")"))).otherwise(F.col("name"))
    return renamed.withColumn("name", name).select(*entities.columns), both


def keep_lowest(df: DataFrame, *key: str) -> DataFrame:
    """The row of the lowest id of each key."""
    return df.groupBy(*key).agg(F.min("id").alias("id"))


def replay(pending: DataFrame) -> DataFrame:
    """Statements from requests (entity_id, entity_name, pending: array of predicate, object, object_type, confidence), with defaults."""
    x = pending.select("entity_id", "entity_name", F.explode("pending").alias("s"))
    return x.select(
        "entity_id",
        F.concat_ws(" ", "entity_name", "s.predicate", "s.object").alias("text"),
        "s.predicate",
        "s.object",
        F.coalesce("s.object_type", F.lit("literal")).alias("object_type"),
        F.coalesce("s.confidence", F.lit(0.7)).alias("confidence"),
        F.lit("verification").alias("source"),
    )


def decide(requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests after decisions (request_id, action: use_existing, create_new, merge or reject; entity_id), new entities, statements.

    create_new makes an entity of the candidate's name (its request id, negated, until the store numbers it).
    """
    j = requests.join(decisions, "request_id", "left")
    target = F.when(F.col("action") == "create_new", -F.col("request_id")).otherwise(F.col("entity_id"))
    status = F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "merge", "merged").when(F.col("action").isNull(), "pending").otherwise("approved")
    after = j.select("request_id", "candidate_name", status.alias("status"), F.when(F.col("action") != "reject", target).alias("verified_entity_id"), "pending")
    made = j.where("action = 'create_new'").select((-F.col("request_id")).alias("id"), F.col("candidate_name").alias("name"), F.lit("verified").alias("verification_status"))
    taken = after.where(F.col("status").isin("approved", "merged")).select(F.col("verified_entity_id").alias("entity_id"), F.col("candidate_name").alias("entity_name"), "pending")
    return after.drop("pending"), made, replay(taken)


def latest_reviews(queue: DataFrame) -> DataFrame:
    """The newest record of each review id; ties go to the later action in order of name."""
    return queue.groupBy("review_id").agg(F.max(F.struct("at", "action")).alias("x")).select("review_id", "x.at", "x.action")
