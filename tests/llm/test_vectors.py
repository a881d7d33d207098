"""Top-k search and clustering against brute force in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import clustering, maxproduct
from quillgraph.llm import vectorblocks as B

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string, d string, rank string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "id", None, "d", "r", 1) for i, v in rows], SCHEMA)


def whole(v, factor):
    return [math.floor(x * factor) if abs(x) < 1e200 else int(x) * factor for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_search(rows, every, k, factor):
    kept = [(i, whole(v, factor)) for i, v in rows if i is not None and usable(v)]
    out = []
    for i, v in kept:
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j) for j, w in kept if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def searched(df, every, k):
    got = maxproduct.search(df, F.col("id") % every == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def mixed(seed=5, n=400, d=12):
    """Lengths over several magnitudes, few strong axes, copies, and rows of every odd kind."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, d)) * np.geomspace(3, 0.05, d) * np.exp(g.normal(size=(n, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(3, rows[9][1]), (20, rows[20][1]), (20, rows[21][1])]  # repeated ids
    rows += [(1000, None), (1001, [None] * d), (1002, [NAN] * d), (1003, [INF] * d), (None, rows[0][1]), (1020, []), (1021, []), (1040, [1.0, 2.0]), (1041, [3.0, -1.0])]
    rows += [(1060, [0.0] * d), (1061, [-5.0] * d)]
    return rows


@pytest.mark.parametrize("every,k", [(20, 10), (7, 3)])
def test_search_equals_brute_force(spark, every, k, monkeypatch):
    rows = mixed()
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)  # many blocks, columns and bands
    monkeypatch.setattr(maxproduct, "COLUMN_BLOCKS", 2)
    monkeypatch.setattr(maxproduct, "BAND_BLOCKS", 1)
    assert searched(frame(spark, rows), every, k) == brute_search(rows, every, k, maxproduct.FACTOR)


def test_search_of_huge_components(spark):
    rows = mixed(n=40, d=4) + [(2000, [1e30, -2e5, 0.5, 3.0]), (2020, [3e6, 1.5, -4e6, 2.0]), (2021, [1e200, 1.0, 1.0, 1.0]), (2040, [-1e300, 1e300, 0.0, 1.7e308])]
    assert searched(frame(spark, rows), 20, 5) == brute_search(rows, 20, 5, maxproduct.FACTOR)


def test_search_of_nothing(spark):
    assert searched(frame(spark, []), 20, 5) == []
    assert searched(frame(spark, [(0, None), (1, [1.0])]), 20, 5) == []
    assert searched(frame(spark, [(0, [1.0])]), 20, 5) == []


def test_sieves_leave_out_most_pairs_and_no_result():
    g = np.random.default_rng(1)
    x = np.floor(1024 * g.normal(size=(2000, 32)) * np.geomspace(2, 0.02, 32) * np.exp(0.7 * g.normal(size=(2000, 1)))).astype(np.int64)
    norms = np.sqrt((x * x).sum(1)) * (1 + 1e-9)
    order = np.argsort(-norms)
    x, norms = x[order], norms[order]
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    row = lambda at: {"d": 32, "wide": False, "ids": at.tolist(), "norms": norms[at].tobytes(), "top": float(norms[at].max()), "x": x[at].astype("<i4").tobytes()}
    q, c = maxproduct.Side(row(np.arange(0, 2000, 100)), turn), maxproduct.Side(row(np.arange(2000)), turn)
    scores = x[::100] @ x.T
    scores[np.arange(20), np.arange(0, 2000, 100)] = -(2**62)
    tenth = np.sort(scores, axis=1)[:, -10].astype(float)
    alive = maxproduct.hopeful(q, np.arange(20), c, tenth)
    assert alive[scores >= tenth[:, None]].all()
    assert alive.mean() < 0.1


def test_products_in_every_kind_of_arithmetic():
    for size in (2**10, 2**25, 2**30):
        a = np.array([[size, -size, 3], [1, 2, -size]], np.int64)
        want = a.astype(object) @ a.astype(object).T
        assert (B.products(a, a) == want).all()
        assert (clustering.distances(a, -a) == np.array([[sum((int(x) + int(y)) ** 2 for x, y in zip(r, s)) for s in a] for r in a], object)).all()


def brute_clusters(rows, k, rounds, dims, factor, seed):
    kept = [(i, whole(v, factor)) for i, v in rows if usable(v) and len(v) == dims]
    raw = {id(w): v for (_, w), v in zip(kept, [v for _, v in rows if usable(v) and len(v) == dims])}
    sha = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    c = [w for _, w in sorted(kept, key=lambda r: (sha(r[0]), raw[id(r[1])]))[:k]]
    near = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(w)[1] for _, w in kept]
        groups = [[w for (_, w), o in zip(kept, own) if o == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else m for g, m in zip(groups, c)]
    last = [(i, *near(w)) for i, w in kept]
    per = {j: sum(d for _, d, o in last if o == j) for j in range(len(c))}
    cut = lambda n: min(n, 2**63 - 1)
    return sorted([(i, j, cut(d), cut(per[j]), cut(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last], key=repr)


def clustered(df, **args):
    got = clustering.cluster(df, **args).assigned()
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("k,rounds", [(6, 4), (500, 2), (1, 1)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = mixed(n=120)
    assert clustered(frame(spark, rows), k=k, rounds=rounds, dims=12) == brute_clusters(rows, k, rounds, 12, clustering.FACTOR, clustering.SEED)


def test_clusters_of_huge_components(spark):
    rows = mixed(n=30, d=4) + [(500, [3e7, 1.0, 2.0, 3.0]), (501, [-3e7, 5e6, 2.0, 3.0]), (502, [1e30, 0.0, 0.0, 1.0]), (503, [1.7e308, 0.0, 0.0, 1.0])]
    assert clustered(frame(spark, rows), k=5, rounds=3, dims=4) == brute_clusters(rows, 5, 3, 4, clustering.FACTOR, clustering.SEED)


def test_clusters_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = mixed(n=150)
    want = clustered(frame(spark, rows), k=7, rounds=3, dims=12)
    monkeypatch.setattr(B, "BLOCK_ROWS", 5)
    assert clustered(frame(spark, rows).repartition(7), k=7, rounds=3, dims=12) == want


def test_clusters_of_nothing(spark):
    got = clustering.cluster(frame(spark, [(1, None), (2, [1.0])])).assigned()
    assert got.collect() == [] and got.columns[0] == "id"


def test_sums_go_on_beyond_64_bits():
    a = np.array([2**62, 1], np.int64)
    assert clustering.plus(clustering.plus(a, a), a).tolist() == [3 * 2**62, 3]
