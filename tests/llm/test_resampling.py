"""Importance resampling against the definition, row by row."""

import hashlib
import math
import re
import zlib
from collections import Counter

from quillgraph.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, percent, least, buckets):
    def features(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in rows), key=repr)


def got(docs, target, **args):
    out = resampling.resample(docs, target, **args)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_the_definition(spark, odd, none):
    target = ["the quick brown fox", None, "", "W1x1 w2x2 Ä ß", "lazy dog over the lazy dog"]
    asked = spark.createDataFrame([(t, 1, 2) for t in target], "text string, bucket int, gain int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for args in ({"percent": 60, "least_words": 1, "buckets": 97}, {"percent": 5, "least_words": 20, "buckets": 10_000}, {"percent": 100, "least_words": 0, "buckets": 40_000}):
        assert got(odd, asked, **args) == brute(docs, target, args["percent"], args["least_words"], args["buckets"])
    assert got(none, asked) == []
    assert got(odd, asked.where("false"), percent=50) == brute(docs, [], 50, 20, 10_000)


def test_ranks_over_many_parts(spark):
    docs = [(i % 500 if i % 7 else None, " ".join(f"w{(i * j) % 83}" for j in range(5 + i % 40))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    asked = spark.createDataFrame([("w1 w2 w3 w5 w8 w13",)], "text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = got(df, asked, percent=30)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(docs, ["w1 w2 w3 w5 w8 w13"], 30, 20, 10_000)
    # Which of several rows of one id and one score has which rank is open; the ranks of an id and score are not.
    assert rows == want
    assert sorted(r[5] for r in rows if r[5]) == list(range(1, len([r for r in want if r[5]]) + 1))


def test_runs_without_python_workers(spark, odd):
    plan = resampling.resample(odd, odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
