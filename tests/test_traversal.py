"""Traversal and components against brute force, with hubs, chains and many starts."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.operators.components import components


def brute(edges, start, depth, directed):
    to = {}
    for a, b in edges:
        if a != b or directed:
            to.setdefault(a, set()).add(b)
            if not directed:
                to.setdefault(b, set()).add(a)
    seen, front = ({} if directed else {start: 0}), {start}
    k = 0
    while front and (depth is None or k < depth):
        k += 1
        front = {b for a in front for b in to.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(front, k)
    return {(start, n) if directed else (start, n, k) for n, k in seen.items() if directed or k}


def hub_graph(seed=2):
    rng = random.Random(seed)
    edges = [("hub", f"l{i}") for i in range(300)] + [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("l0", "c0"), ("l1", "l1"), ("c3", "c3")]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(80)] + [("hub", "l0"), ("l299", "r0")]
    return edges


def test_hops_from_many_starts_around_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 16)
    edges = hub_graph()
    e = spark.createDataFrame(edges, "src string, dst string")
    starts = sorted({x for edge in edges for x in edge})[::9] + ["hub", "nobody"]
    s = spark.createDataFrame([(x,) for x in starts + starts[:2]], "id string")
    for depth in (0, 1, 3, 5):
        got = [tuple(r) for r in graph.hops(e, s, depth).select("start", "node", "hop").collect()]
        assert len(got) == len(set(got)) and set(got) == {r for x in starts for r in brute(edges, x, depth, False)}
    a = graph.Adjacency(graph.undirected(e))
    sizes = {r["a"]: (r["n"], r["most"]) for r in a.blocks.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("to")).alias("most")).collect()}
    assert sizes["hub"][0] >= 15 and sizes["hub"][1] <= 48


def test_reach_along_a_long_chain_and_a_cycle(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(21)] + [("n021", "n018"), ("x", "x")]
    e = spark.createDataFrame(edges, "src string, dst string")
    starts = ["n000", "n010", "x", "gone"]
    got = {tuple(r) for r in graph.reach(e, spark.createDataFrame([(x,) for x in starts], "id string")).collect()}
    assert got == {r for x in starts for r in brute(edges, x, None, True)}


def test_components_whatever_the_order(spark):
    edges = hub_graph(7) + [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(70)] + [(None, "a"), ("b", None)]
    random.Random(1).shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root}
    e = spark.createDataFrame(edges, "u string, v string")
    assert {tuple(r) for r in components(e).collect()} == want
    assert components(e.where("false")).isEmpty()
