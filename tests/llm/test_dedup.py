"""Near-duplicates, suffix-array dedup, decontamination, mixing, pipeline."""

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bagminhash, common, components, decontam, mixing, suffix_dedup

SF = "/root/testdata/sf0.001"


def multiset(text):
    w = common.words((text or "").encode())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(texts):
    """Smallest id of the component of each id."""
    sets = {k: multiset(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(bagminhash.links, "__defaults__", (0.8, small, 4))
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    texts = {}
    for k in range(60):  # a group whose members are more or less like each other
        w = list(base)
        for i in rng.choice(120, k % 7, replace=False):
            w[i] = f"z{rng.integers(10_000)}"
        texts[k] = " ".join(w)
    texts |= {100: "one two", 101: "one  TWO!", 102: "", 103: None, 104: "a a a a a a a a a b", 105: "a a a a a a a a a a a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
    assert got == brute_classes(texts)
    kept = {r["doc_id"] for r in bagminhash.dedup(docs).collect()}
    assert kept == set(got.values())


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    n = 400
    x, y = rng.integers(0, 6, n), rng.integers(0, 6, n)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    e = np.arange(n, dtype=np.uint64)
    d = np.concatenate([np.zeros((x > 0).sum(), np.int64), np.ones((y > 0).sum(), np.int64)])
    s = bagminhash.signatures(d, np.concatenate([e[x > 0], e[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(10, 30)] + [(1, 2), (5, 5), (7, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(e).collect()}
    assert got == {k: 10 for k in range(11, 31)} | {2: 1, 7: 3}


def brute_removal(rows):
    """kept sha256, bytes, removed, runs of each (id, text), by the definition."""
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = [False] * len(b)
        earlier = {o[k : k + 50] for j, u in rows if i is not None and j is not None and j < i for o in [(u or "").encode()] for k in range(len(o) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in earlier:
                cover[k : k + 50] = [True] * 50
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def report(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.report(df).collect())


@pytest.mark.parametrize("hot", [1024, 1])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abcé "), 70)) for _ in range(12)]
    rows = [(int(k), "".join(rng.choice(parts, 4)) + str(k)) for k in rng.permutation(40)]
    rows += [(50, "x" * 49), (51, "x" * 49), (52, "y" * 300), (53, "y" * 60), (54, "y" * 301), (55, None), (None, "y" * 80), (52, "y" * 300), (53, "z" + "y" * 60), (-3, parts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(df) == brute_removal(rows)


def test_suffix_dedup_on_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 10_000]
    small = odd.where("text is null or length(text) < 10000")
    assert report(small) == brute_removal(rows)
    long = {r["doc_id"]: r for r in suffix_dedup.report(odd.where("doc_id in (7, 8)")).collect()}
    assert long[7]["n_removed"] == 0 and long[8]["n_removed"] == long[7]["n_bytes"]
    assert suffix_dedup.report(none).isEmpty() and suffix_dedup.dedup(none).isEmpty()
    out = suffix_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    first = out.where("doc_id = 6").first()
    assert first["text"] == "" and first["n_chars"] == 0 and first["copy"] == "c"


def test_suffix_dedup_sends_little(spark):
    """Texts go to their blocks compressed, in one row for each task and block, and come back whole; anchors take four bytes."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(2)
    sent = suffix_dedup.blocks(df).toArrow()
    assert sent.num_rows <= 6 and sum(len(x) for x in sent["rows"].to_pylist()) < 0.6 * sum(len(r[1]) for r in rows)
    assert sorted(tuple(r.values()) for r in suffix_dedup.rows_of(sent).to_pylist()) == rows
    keys = suffix_dedup.keys(df, 4, 4).where(F.col("kind") == suffix_dedup.KEY)
    assert keys.where("2 * octet_length(g) <> octet_length(h) or octet_length(h) <> octet_length(doc)").isEmpty() and not keys.isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=1, max_size=6))
def test_deep_shallow_order(tails):
    """Suffixes of one shallow prefix: equal ones get one number, and numbers follow the order of the strings."""
    n = suffix_dedup.LENGTH
    texts = [(("p" * 40) + t).ljust(n, "c")[:n].encode() for t in tails]
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.arange(len(texts)) * n
    index, number = suffix_dedup.deep_shallow(data, place, np.arange(len(texts)))
    got = [texts[i] for i in index]
    assert got == sorted(got)
    assert all((a == b) == (x == y) for a, x in zip(got, number) for b, y in zip(got, number))
    shared = {t for t, c in Counter(texts).items() if c > 1}
    assert shared <= set(got)


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = bagminhash.classes(odd).toPandas()
    assert len(got) == odd.count() and bagminhash.classes(none).isEmpty()
    assert set(got[got.doc_id == 6].class_id) == {5} and set(got[got.doc_id == 8].class_id) == {7} and set(got[got.doc_id == 1].class_id) == {1}
    out = bagminhash.dedup(odd)
    assert out.columns == odd.columns and out.where("doc_id is null").count() == 2


def brute_hits(text, items, window=13):
    w = common.words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        v = common.words((t or "").encode())
        n = min(window, len(v))
        grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_decontamination_against_brute_force(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(1000, "Short one"), (1001, ""), (1002, None), (None, "nobody"), (1000, "Short one")], "item_id long, text string")
    both = bench.select("item_id", "text").unionByName(extra)
    docs = docs.unionByName(spark.createDataFrame([(90_000, "a short, ONE is short one"), (90_001, None), (90_002, "")], "doc_id long, text string"))
    items = [(r["item_id"], r["text"]) for r in both.collect() if r["item_id"] is not None and r["text"] is not None]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.judge(decontam.find(docs, both, block_bytes=block)).collect()}
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs.collect()}
    assert any(v[4] for v in got.values())
    if block > 10_000:
        assert {r["doc_id"] for r in decontam.clean(docs, both).collect()} == {k for k, v in got.items() if not v[4]}


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(20)) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(-3, 18)))], "item_id long, text string")
    h = decontam.find(docs, bench).first()["hits"]
    assert [tuple(x) for x in h] == [(7, 1, 6, 18)]  # "w-3" is two words


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(7)
    for least in (1, 2, 4):
        for _ in range(60):
            ids = rng.integers(0, 4, rng.integers(1, 80)).astype(np.uint32)
            if rng.random() < 0.4:
                ids = np.tile(ids[:9], 9)
            places, keys = decontam.suffix_array(ids, 3, least)
            suffix = {}
            for i in range(len(ids)):
                stop = next((k for k in range(i, len(ids)) if ids[k] == 0), len(ids))
                if stop - i >= least:
                    suffix[i] = ids[i:stop].tolist()
            got = [suffix[p] for p in places.tolist()]
            assert sorted(places.tolist()) == sorted(suffix) and got == sorted(got)
            assert (keys[1:] >= keys[:-1]).all()


def test_longest_matches_against_all_pairs():
    """Every place of a window is covered, and each match is the longest that any item has there."""
    rng = np.random.default_rng(12)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3, rng.integers(1, 14))).encode()) for i in range(12)]
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 4, 60)).encode() for _ in range(20)]
    test = decontam.TestSet(items, 4)
    n_words, found, hits = decontam.matches(test, texts)
    split = {i: t.split() for i, t in items}
    for t, n, f, h in zip(texts, n_words.tolist(), found, hits):
        w = t.split()
        windows = [(k, i, j, min(4, len(x))) for i, x in split.items() for j in range(len(x) - min(4, len(x)) + 1) for k in range(len(w)) if w[k : k + min(4, len(x))] == x[j : j + min(4, len(x))]]
        assert n == len(w) and f == sorted({i for _, i, _, _ in windows})
        cover = {k + d for k, _, _, m in windows for d in range(m)}
        assert {x["doc_start"] + d for x in h for d in range(x["n_words"])} == cover and decontam.covered(h) == len(cover)
        for x in h:
            p, q, m = x["doc_start"], x["item_start"], x["n_words"]
            assert w[p : p + m] == split[x["item_id"]][q : q + m]
            same = [next((d for d in range(len(y) - j) if p + d >= len(w) or w[p + d] != y[j + d]), len(y) - j) for k, i, j, size in windows if k == p and (size == 4 or m < 4) for y in [split[i]]]
            assert m == max(same)


def test_decontamination_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    assert decontam.find(odd, bench).count() == odd.count() and decontam.find(none, bench).isEmpty()
    out = decontam.clean(odd, bench)
    assert out.columns == odd.columns and out.where("doc_id = 6").isEmpty() and out.where("doc_id is null").count() == 2
    assert decontam.clean(odd, bench.limit(0)).count() == odd.count()


def test_rows_of_a_null_id_are_drawn_one_by_one(spark):
    import duckdb

    docs = spark.createDataFrame([(None if i % 3 else i, None if i == 1 else f"text {i}", "a" if i % 2 else None) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs)
    frame = docs.toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))
    keys = got.where("doc_id is null").select("mix_key").distinct().count()
    assert keys == got.where("doc_id is null").count() > 1500
    assert got.where("doc_id is null and copy = 0").count() < 1700  # some are not drawn


def test_hits_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 6, n))
    items = [(i, word(int(rng.integers(2, 30)))) for i in range(40)]
    items += [(100 + k, " ".join(f"u{j}" for j in range(k, k + 18 + k % 3))) for k in range(0, 24, 4)] + [(200, items[3][1])]
    docs = [(i, word(60) + " " + items[i % 40][1] + " " + word(5)) for i in range(30)] + [(90, " ".join(f"u{j}" for j in range(40))), (91, None), (92, "")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1 << 20, 1500, 300):
        found.append(sorted((r["doc_id"], r["n_words"], r["items"], [tuple(h) for h in r["hits"]]) for r in decontam.find(docs, bench, 5, size).collect()))
    assert len(decontam.blocks(bench, 300)) > 5 and any(r[3] for r in found[0])
    assert found[0] == found[1] == found[2]


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "t", "a" if i % 4 else "b", i) for i in range(4000)], "doc_id long, text string, source string, copy int")
    want = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    out = mixing.mix(docs, want, epochs=2.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 4000) < 260 and abs(n["b"] - 4000) < 260
    one = [tuple(r) for r in out.orderBy("mix_key").collect()]
    assert one == [tuple(r) for r in mixing.mix(docs, want, epochs=2.0).orderBy("mix_key").collect()]
    assert one == [tuple(r) for r in mixing.mix(docs, want, epochs=2.0, sent=0).orderBy("mix_key").collect()]  # salted join
    dotted = docs.withColumn("a.b", docs["doc_id"])
    assert mixing.mix(dotted, want).columns == ["doc_id", "text", "source", "a.b", "copy", "mix_key"]
    per = Counter(r["doc_id"] for r in out.where("source = 'b'").collect())
    assert np.var([per[i] for i in range(0, 4000, 4)]) == pytest.approx(4, rel=0.25)  # as of a Poisson number
    assert mixing.mix(none).isEmpty() and set(mixing.mix(odd, epochs=20.0).columns) == set(odd.columns) | {"mix_key"}
    assert mixing.mix(docs, want.where("source = 'a'")).where("source = 'b'").isEmpty()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert len(seen[1]) < len(seen[0])
    roots = brute_classes({k: r["text"] for k, r in seen[1].items()})
    assert set(seen[2]) == set(roots.values())
    removal = {r[0]: r for r in brute_removal([(k, r["text"]) for k, r in seen[2].items()])}
    assert set(seen[3]) == set(seen[2])
    for k, r in seen[3].items():
        assert (r["text"] == seen[2][k]["text"]) == (removal[k][2] == 0) and r["n_chars"] == len(r["text"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(seen[4]) == {k for k, r in seen[3].items() if not brute_hits(r["text"], items)[4]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {"copy", "mix_key"} < set(last.columns) and set(r["doc_id"] for r in last.collect()) <= set(seen[4])


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeated ids, clashing and dotted names, and nothing at all, through every stage."""
    for docs in (odd.withColumn("a.b", F.lit(1)), none.withColumn("a.b", F.lit(1))):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, docs, SF))
            assert out.columns == docs.columns and out.count() <= n, name
            if n:
                assert name == "quality_filter" or not out.where("doc_id is null").isEmpty(), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert set(last.columns) == set(docs.columns) | {"copy", "mix_key"}


def test_no_import_from_the_rest():
    here = os.path.dirname(common.__file__)
    for f in os.listdir(here):
        if f.endswith(".py"):
            text = open(os.path.join(here, f)).read()
            assert "quillgraph.functions" not in text and "quillgraph.operators" not in text and "localCheckpoint" not in text


def test_arrow_helpers():
    col = pa.array(["ab", None, "ü", ""]).slice(1)
    data, offs = common.buffers(col)
    assert data.tobytes() == "ü".encode() and offs.tolist() == [0, 0, 2, 2] and common.byte_list(col) == [b"", "ü".encode(), b""]
    b = pa.record_batch([pa.array(["x" * 10] * 10)], ["text"])
    assert [s.num_rows for s in common.steps(iter([b]), size=25)] == [2] * 5


def test_suffix_dedup_tells_segments_of_one_anchor_apart(spark):
    """Unrepeated texts around one phrase whose segments agree in the upper 32 bits of their hash."""
    texts = [
        "egzxmykauxxudwuyheprsvzmqdroyiwfxuiunxdpmucxfikbxwekliglppbezwjsfqufltdmbykhunmvoups",
        "cqlqleoptpcqnnusncgntannghsltikbsviunxdpmucxfikbxwivvvvrhvqfpkxtxskibqxmprhmjfrcapxd",
        "khjdajbotdlyprtpblxddspkqwznbqksuhiunxdpmucxfikbxwsclncqbbvxiderpxlvwfgsgekhlavdvyhp",
        "edrzifrvbddbvmswdjprdynstdkqnayqjxiunxdpmucxfikbxwarhjcztgforyzxeumrpqgqfyezlmfieqon",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.report(docs).collect()} == {(i, 0) for i in range(4)}


def test_blocks_spread_ids_of_any_pattern(spark):
    """The block of an id is Spark's, and ids that are multiples of the number of blocks do not meet in one."""
    ids = np.concatenate([np.arange(-5, 5), np.arange(1000) * 64, np.array([2**62, -(2**63), 2**63 - 1])])
    df = spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select("doc_id", F.pmod(F.hash("doc_id"), F.lit(64)).alias("b"))
    got = suffix_dedup.block_of(ids, 64)
    assert {r["doc_id"]: r["b"] for r in df.collect()} == dict(zip(ids.tolist(), got.tolist()))
    assert np.bincount(got, minlength=64).max() < 40


def test_suffix_dedup_with_ids_that_are_multiples(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(9)
    shared = "".join(map(chr, rng.integers(97, 123, 90)))
    rows = [(64 * i, "".join(map(chr, rng.integers(97, 123, 60))) + (shared if i % 3 else "") + "".join(map(chr, rng.integers(97, 123, 40)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1))
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.report(docs).collect()}
    assert got == set(brute_removal(rows))
    assert suffix_dedup.dedup(docs).columns == docs.columns


def test_suffix_dedup_calls_for_few(spark):
    """Texts that share phrases shorter than a window are not sent to be compared; those that share a window are."""
    rng = np.random.default_rng(4)
    any_ = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase, passage = any_(30), any_(50)

    def called(rows):
        packed = suffix_dedup.answers(suffix_dedup.keys(spark.createDataFrame(rows, "doc_id long, text string"), 3, 3), 3)
        return sum(int(np.count_nonzero(np.frombuffer(r["a"], np.int32))) for r in packed.select("a").collect())

    assert called([(i, any_(60) + phrase + any_(60)) for i in range(40)]) == 0
    assert called([(i, any_(60) + passage + any_(60)) for i in range(5)]) >= 5


@pytest.mark.parametrize("hot", [1024, 1])
def test_suffix_dedup_of_windows_at_any_place(spark, monkeypatch, hot):
    """Shared strings of 49 to 60 bytes at the start, amid and at the end of texts, whose short strings occur more than once within a window."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    any_ = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    short = [any_(16), any_(18), any_(7) * 3]
    shared = [any_(n) for n in (49, 50, 51, 60)] + [(s + any_(k)) * 4 for s in short for k in (1, 3)] + [any_(15) + s + any_(3) + s for s in short]
    rows = []
    for k, x in enumerate(shared):
        a = int(rng.integers(0, max(1, len(x) - 50)))
        for n, text in enumerate((x + any_(40), any_(40) + x + any_(40), any_(40) + x, x, any_(30) + x[a : a + 50] + any_(30), short[k % 3] + any_(2) + x + any_(2) + short[k % 3])):
            rows.append((int(rng.integers(0, 1000)) * 100 + 10 * n + k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(df) == brute_removal(rows)


def test_copies_with_one_identity(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "identity", lambda g, h: np.zeros(len(g), np.uint64))
    g, h, doc = np.array([5, 7, 5, 7, 5], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64), np.arange(5)
    order, _, new = suffix_dedup.copies(g, h, doc)
    assert sorted(x.tolist() for x in np.split(order, np.flatnonzero(new)[1:])) == [[0, 4], [1, 3], [2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_do_not_depend_on_bucket_sizes(spark, monkeypatch, seed):
    """Families with several centres: the classes are those of brute force whatever counts as a small bucket, on a grid of tasks too."""
    rng = np.random.default_rng(seed)
    texts = {}
    for family in range(3):
        base = [f"f{family}w{x}" for x in range(90)]
        centres = [base] + [[*base[:c], *(f"c{c}{k}" for k in range(6)), *base[c + 6 :]] for c in (20, 50, 70)]
        for _ in range(14):
            w = list(centres[rng.integers(4)])
            for i in rng.choice(90, rng.integers(0, 4), replace=False):
                w[i] = f"z{rng.integers(10_000)}"
            texts[len(texts)] = " ".join(w)
    order = rng.permutation(len(texts))
    texts = {int(order[k]): t for k, t in texts.items()}
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(bagminhash, "GRID", 2)
    for small in (2, 3, 24):
        monkeypatch.setattr(bagminhash.links, "__defaults__", (0.8, small, 3))
        got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
        assert got == want, small


def test_dedup_of_nothing(spark, none, odd):
    assert bagminhash.dedup(none).isEmpty() and bagminhash.dedup(none).columns == none.columns
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    assert decontam.clean(none, bench).isEmpty()
    dotted = odd.withColumn("a.b", F.lit(1))
    assert bagminhash.dedup(dotted).columns == dotted.columns


def test_late_link_to_the_hub_bridges_to_a_further_text(spark):
    """3 is linked to the main hub 0, whom it met in no bucket; 4 is linked to 3 alone, with whom it meets under hub 1."""
    base = [f"w{k}" for k in range(120)]
    changed = {0: [], 1: [10, 20], 2: [15], 3: [60, 70], 4: [60, 70, 90, 100]}
    texts = {k: " ".join(f"z{i}" if i in c else w for i, w in enumerate(base)) for k, c in changed.items()}
    assert set(brute_classes(texts).values()) == {0}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bands = [(0, [1]), (1, [1, 2]), (2, [1]), (3, [2]), (4, [2])]
    linked, roots = bagminhash.links(spark.createDataFrame(bands, "doc_id long, bands array<long>"), docs, 0.8, 2, 4)
    assert {r["node"]: r["root"] for r in roots.collect()} | {0: 0} == brute_classes(texts)
    assert (3, 4) in {(r["a"], r["b"]) for r in linked.collect()}


def test_clean_judges_each_row_over_blocks_of_the_benchmark(spark, monkeypatch):
    """Null and repeated ids; the rule is the same whether the benchmark fits one block or not."""
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(40))) for i in range(20)], "item_id long, text string")
    bad, good = " ".join(f"b3x{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    docs = spark.createDataFrame([(None, bad), (None, good), (1, bad), (1, good), (2, good)], "doc_id long, text string")
    real = decontam.blocks
    for size in (8 << 20, 1000):
        monkeypatch.setattr(decontam, "blocks", lambda b, *_, n=size: real(b, n))
        got = decontam.clean(docs, bench).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, good), (1, good), (2, good)]
