"""Traversal and graph statistics over edge DataFrames (src, dst, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """a, b for both directions, without loops."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


#: Neighbours in a block of an adjacency, on average at most.
BLOCK = 1024


class Adjacency:
    """Neighbours of each node in blocks of some BLOCK; a hub has many blocks, which lie in different tasks.

    steps: (a, b). blocks: a, block, to (sorted neighbours); pieces: a, n (blocks) of the nodes that have more than one.
    """

    def __init__(self, steps: DataFrame):
        steps = cut(steps.select("a", "b").distinct())
        many = steps.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > BLOCK)
        self.pieces = cut(many.select("a", F.ceil(F.col("degree") / BLOCK).cast("int").alias("n")))
        dealt = steps.join(self.pieces, "a", "left").withColumn("block", F.pmod(F.xxhash64("b"), F.coalesce("n", F.lit(1))).cast("int"))
        self.blocks = cut(dealt.groupBy("a", "block").agg(F.array_sort(F.collect_list("b")).alias("to")))

    def step(self, front: DataFrame) -> DataFrame:
        """start, node: the neighbours of a frontier (start, node); a hub's meets each of its blocks by itself."""
        asked = front.select("start", F.col("node").alias("a")).join(self.pieces, "a", "left")
        asked = asked.select("start", "a", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("block"))
        return asked.join(self.blocks, ["a", "block"]).select("start", F.explode("to").alias("node")).distinct()


class _Seen:
    """What was reached so far, in tables whose sizes differ by powers of two: of n rounds each row is rewritten some log n times."""

    def __init__(self):
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, df: DataFrame) -> None:
        level = 0
        while self.parts and self.parts[-1][0] == level:
            df = cut(df.unionByName(self.parts.pop()[1]))
            level += 1
        self.parts.append((level, df))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for _, p in self.parts])


def _traverse(steps: DataFrame, starts: DataFrame, depth: int | None, from_start: bool) -> DataFrame:
    """start, node, hop by breadth: from_start says whether the start counts as seen."""
    graph = Adjacency(steps)
    begin = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen, front, k = _Seen(), cut(begin), 0
    if from_start:
        seen.add(front.withColumn("hop", F.lit(0)))
    while depth is None or k < depth:
        k += 1
        reached = graph.step(front)
        if seen.parts:
            reached = reached.join(seen.all().select("start", "node"), ["start", "node"], "left_anti")
        front = cut(reached)
        if front.isEmpty():
            break
        seen.add(front.withColumn("hop", F.lit(k)))
    return seen.all() if seen.parts else begin.withColumn("hop", F.lit(0)).where("false")


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, hop: every node within `depth` undirected hops of each start (id), at its least hop; not the start itself.

    Only the frontier is joined on, with the blocks of its nodes' neighbours; a node is expanded once for each
    start. Every round is written out, so that plans stay short however deep it goes.
    """
    return _traverse(undirected(edges), starts, max(0, depth), True).where("hop > 0")


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: every node that directed edges lead to from each start (id). Each round goes on from new nodes only, so cycles end it."""
    return _traverse(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), starts, None, False).select("start", "node")


def ego_network(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (start, node, group: focus, entity or extended) and edges (start, src, dst, type) of the net around each start."""
    found = hops(edges, starts, depth)
    group = F.when(F.col("hop") == 0, "focus").when(F.col("hop") == 1, "entity").otherwise("extended")
    all_ = found.unionByName(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hop")))
    inside = all_.select("start", "node")
    own = edges.select("src", "dst", "type").distinct()
    net = own.join(inside.withColumnRenamed("node", "src"), "src").join(inside.withColumnRenamed("node", "dst"), ["start", "dst"])
    return all_.select("start", "node", group.alias("group")), net.select("start", "src", "dst", "type")


def degrees(edges: DataFrame) -> DataFrame:
    """id, connections: one for each end of every distinct (src, dst, type)."""
    e = edges.select("src", "dst", "type").distinct()
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("connections"))


def hub_boost(degree: DataFrame, hub: str) -> DataFrame:
    """The hub's degree becomes at least the largest plus one. Off unless asked for."""
    top = degree.agg(F.max("connections") + 1).scalar()
    return degree.select("id", F.when(F.col("id") == hub, F.greatest("connections", top)).otherwise(F.col("connections")).alias("connections"))


def connection_stats(links: DataFrame) -> DataFrame:
    """name, total and connections (name, count; most first) over links of names (a, b), both ways; a loop counts once."""
    both = links.select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("b").alias("name")))), lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("n")))
    return pairs.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("total"), listed.alias("connections"))


def inverse_name(name: F.Column, source: F.Column) -> F.Column:
    """Name of the relation the other way: `owners` gives owner, `created_by` gives created; else the class of the source."""
    return F.when(name.rlike("_by$"), F.regexp_replace(name, "_by$", "")).when(name.rlike("s$"), F.regexp_replace(name, "s$", "")).otherwise(F.lower(source))


def with_inverses(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, type, src_class) and the inverse edge of each, once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), inverse_name(F.col("type"), F.col("src_class")).alias("type"))
    return edges.select("src", "dst", "type").unionByName(back).distinct()


def ancestors(types: DataFrame) -> DataFrame:
    """type, ancestor over a (type, parent) table: the chain of `extends`, followed until nothing is new."""
    known = cut(types.where("parent is not null").select("type", F.col("parent").alias("ancestor")).distinct())
    parents = types.where("parent is not null").select(F.col("type").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        new = cut(known.join(parents, "ancestor").select("type", F.col("next").alias("ancestor")).distinct().join(known, ["type", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
