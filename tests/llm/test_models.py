"""Classifiers, language ID, PPM."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import gbt, langid, ppm, quality, registry, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("name,target,least", [("op2_quality_classifier", "quality", 0.98), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, target, least):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    threshold = 0.7 if target == "quality" else 0.3
    assert (got.predicted == (got.score >= threshold)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert auc(both.score.to_numpy(), both[target].to_numpy()) >= least


def test_language_accuracy(spark):
    got = registry.op5_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas(), on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() >= 0.98


@pytest.mark.parametrize("module,target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, none, labels, module, target):
    model = module.fit(odd, labels, target)
    got = module.score(odd, model).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    assert module.score(none, model).isEmpty()
    assert module.score(odd, module.fit(odd, labels.limit(0), target)).count() == odd.count()
    assert module.score(odd, module.fit(none, labels, target)).count() == odd.count()
    if module is quality:
        kept = quality.keep(odd, model, threshold=0.0)
        assert kept.columns == odd.columns and kept.count() == odd.count() and quality.keep(none, model).isEmpty()


def test_quality_features_against_brute_force():
    """The statistics of each text, from their names alone."""
    texts = ["Hello, World 12!\n\nthe the cat | x\nthe the cat | x", "", None, "  \n ", "Ünï a a a", "one"]
    got = quality.features(pa.array(texts))
    for t, row in zip(texts, got):
        b = (t or "").encode()
        w, lines, x = b.split(), [s for s in b.split(b"\n") if s], dict(zip(quality.FEATURES, row))
        share = lambda chars: sum(c in chars for c in b) / max(1, len(b))  # noqa: E731, B023
        assert x["log_bytes"] == pytest.approx(math.log1p(len(b))) and x["log_words"] == pytest.approx(math.log1p(len(w)))
        assert x["upper"] == pytest.approx(share(range(65, 91))) and x["digit"] == pytest.approx(share(b"0123456789")) and x["newline"] == pytest.approx(share(b"\n"))
        assert x["bar"] == pytest.approx(share(b"|")) and x["punct"] == pytest.approx(share(b".,;:?'\"()-")) and x["non_ascii"] == pytest.approx(share(range(192, 256)))
        if w:
            top = [n for _, n in Counter(w).most_common(3)]
            assert x["word_bytes"] == pytest.approx(sum(map(len, w)) / len(w)) and x["distinct_words"] == pytest.approx(len(set(w)) / len(w))
            assert x["top_word"] == pytest.approx(top[0] / len(w)) and x["top3_words"] == pytest.approx(sum(top) / len(w)) and x["longest_word"] == max(map(len, w))
            assert x["distinct_lines"] == pytest.approx(len(set(lines)) / max(1, len(lines))) and x["line_bytes"] == pytest.approx(math.log1p(len(b) / max(1, len(lines))))
            assert x["distinct_pairs"] == pytest.approx(len(set(zip(w, w[1:]))) / max(1, len(w) - 1)) and x["same_next"] == pytest.approx(sum(a == c for a, c in zip(w, w[1:])) / len(w))
        else:
            assert x["distinct_words"] == x["top_word"] == x["word_bytes"] == 0


def naive_ngrams(text):
    """Distinct n-grams of the lower-cased text, runs of what is no letter as one space."""
    c = []
    for x in (text or "").lower():
        if x.isalpha() or not c or c[-1].isalpha():
            c.append(x if x.isalpha() else " ")
    return {"".join(c[i : i + n]) for n in toxicity.ORDERS for i in range(len(c) - n + 1)}


def test_toxicity_features_against_brute_force(spark):
    """Which features are chosen, and the score of every text, from n-grams counted one by one."""
    rng = np.random.default_rng(8)
    words = ["lovely", "day", "idiot", "tree", "scum", "Ünder", "river", "x-1"]
    rows = [(i, " ".join(rng.choice(words, 12))) for i in range(200)] + [(200, ""), (201, None)]
    toxic = {i: int("idiot" in t and "scum" in t) for i, t in rows[:200] if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    sets = {i: naive_ngrams(t) for i, t in rows}
    bucket = {}  # the n-grams are the features; the hash only names them
    for g in set().union(*sets.values()):
        b, _ = toxicity.grams([g])
        bucket[g] = int(b[-1])
    n = Counter(toxic.values())
    want = set()
    seen = Counter((b, y) for i, y in toxic.items() for b in {bucket[g] for g in sets[i]})
    for b in {b for b, _ in seen}:
        pos, neg = seen[b, 1], seen[b, 0]
        r = math.log((pos + 1) / (n[1] + 2)) - math.log((neg + 1) / (n[0] + 2))
        if abs(r) * abs(pos / n[1] - neg / n[0]) >= toxicity.TELLING:
            want.add(b)
    assert set(np.flatnonzero(model.weight)) == want
    for x in toxicity.score(docs, model).collect():
        z = model.intercept + sum(float(model.weight[b]) for b in {bucket[g] for g in sets[x["doc_id"]]})
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_flat_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.train(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == (y[1500:] > 0)).mean() > 0.95
    for i in range(20):  # the arrays, walked one node at a time
        z = m.base
        for f, c, v in zip(m.feature, m.cut, m.leaf):
            k = 0
            for _ in range(m.depth):
                k = 2 * k + 1 + (x[i, f[k]] > c[k])
            z += v[k - (2**m.depth - 1)]
        assert m.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + math.exp(-z)))
    assert gbt.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((1, 3)))[0] == 0.5


def test_language_on_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (10, "und")} <= got and not any(x == "und" for i, x in got if i in (3, 4, 5, 7))
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}
    assert langid.predict(none, langid.fit(odd)).isEmpty()


def test_naive_bayes_against_brute_force(spark):
    """Every score from n-grams counted one by one, with the priors of all documents of a language."""
    rng = np.random.default_rng(4)
    vocab = {"aa": ["kato", "miru", "Saké", "tama"], "bb": ["strolz", "ngrat", "wurp", "tama"], "cc": ["éluo", "iaéa", "ouie"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 4)) + "!", k) for i, k in enumerate(rng.choice(["aa", "aa", "bb", "cc"], 120).tolist())] + [(120, "kato wurp", None), (121, "12 34", "aa"), (122, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(t):
        c = "".join(x if x.isalpha() else " " for x in (t or "").lower())
        out = Counter()
        for n in langid.ORDERS:
            for i in range(len(c) - n + 1):
                b, _, _ = langid.buckets([c[i : i + n]])
                out[int(b[-1])] += 1
        return out

    train = [(t, k) for i, t, k in rows if k and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    counts, n = {k: Counter() for k in vocab}, Counter(k for _, k in train)
    for t, k in train:
        counts[k] += grams(t)
    size = {k: sum(c.values()) + langid.SMOOTHING * (1 << langid.BITS) for k, c in counts.items()}
    for r in langid.predict(docs, langid.fit(docs)).collect():
        text = rows[r["doc_id"]][1]
        if not any(x.isalpha() for x in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        g = grams(text)
        log = {k: math.log(n[k] / len(train)) + sum(m * math.log((counts[k][b] + langid.SMOOTHING) / size[k]) for b, m in g.items()) for k in vocab}
        best = max(log, key=log.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), rel=1e-3)


def naive_ppm(train, text, order=ppm.ORDER):
    """Code length in log10 with escapes by d / (n + d) and exclusion, from counts of every context."""
    follow = {}
    for t in train:
        s = [255] * order + list(t) + [255]
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    s, total = [255] * order + list(text) + [255], 0.0
    for i in range(order, len(s)):
        out, escape = set(), 0.0
        for k in range(order, -1, -1):
            c = {x: n for x, n in follow.get(tuple(s[i - k : i]), {}).items() if x not in out}
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                total += escape + math.log10(c[s[i]] / (n + d))
                break
            if n:
                escape += math.log10(d / (n + d))
            out |= set(c)
        else:
            total += escape - math.log10(256 - len(out))
    return total


def ppm_tokens(t):
    """Words between ASCII white space, lower-cased, and the end."""
    return t.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() + [b""]


def test_ppm_against_brute_force(spark):
    train = ["abracadabra", "abraham", "", "the the theory", "ünï"]
    ask = train + ["abrax", "zzz", "the", None]
    docs = spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs, docs.where(f"doc_id < {len(train)}")).collect()}
    c = Counter(w for t in train for w in ppm_tokens(t.encode()))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(ask):
        w = ppm_tokens((t or "").encode())
        assert got[i]["score"] == pytest.approx(naive_ppm([x.encode() for x in train], (t or "").encode()), rel=1e-4)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)


def test_ppm_on_odd_rows(spark, odd, none):
    got = ppm.score(odd, ppm.training(odd)).toPandas()
    assert len(got) == odd.count() and (got.score <= 0).all() and (got.base_score <= 0).all()
    assert ppm.score(none, ppm.training(odd)).isEmpty()
    assert {r["n_known"] for r in ppm.score(odd, none).collect()} == {0}


def test_ppm_tokens_against_brute_force_over_many_buckets(spark):
    """Rare and frequent tokens, long ones too, alike over many blocks and buckets."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 5000) + " " + "q" * int(rng.integers(1, 300)) for _ in range(80)] + [None, "", "W1 w1\tW2\x0bw3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in ppm_tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    for r in ppm.score(docs, ppm.training(docs), block_bytes=500).collect():
        w = ppm_tokens((texts[r["doc_id"]] or "").encode())
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)


def test_ppm_keeps_every_context_over_many_shards(spark):
    """More contexts of an order than any one table had room for (32,768), and shards of a part of them each."""
    rng = np.random.default_rng(3)
    train = ["".join(map(chr, rng.integers(97, 123, 2500))) for _ in range(24)]
    assert all(len({t[i : i + k] for t in train for i in range(len(t) - k + 1)}) > 32768 for k in (4, 5))
    ask = [t[1000:1300] for t in train[::4]] + ["zzz", ""]
    rows = list(enumerate(train + ask))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = ppm.score(docs.where(f"doc_id >= {len(train)}"), docs.where(f"doc_id < {len(train)}"), block_bytes=200)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    follow = [t.encode() for t in train]
    for i, t in rows[len(train) :]:
        assert got[i] == pytest.approx(naive_ppm(follow, t.encode()), rel=1e-6)
