import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import matchers as M
from quillgraph.functions import strings as S
from quillgraph.functions import text as X
from quillgraph.functions import vector as V
from quillgraph.operators import blocking, fuzzy, resolve


def values(spark, make, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(make(*[F.col(c) for c in df.columns]).alias("x")).collect()]


STREETS = {
    "123 Main Street": "123 main st",
    "101 Elm Blvd.": "101 elm blvd",
    "123 North Main Street": "123 n main st",
    "456 South West 5th Ave": "456 s w 5th ave",
    "123 Main St., Apt. 4B": "123 main st apt 4b",
    "100  -  200  Main   St": "100 200 main st",
}
CITIES = {"New York City": "new york", "Los Angeles, CA": "los angeles", "St. Louis": "st louis", "Fort Worth": "ft worth", "Mount Vernon": "mt vernon", "": "", None: ""}
STATES = {"California": "CA", "new york": "NY", "tx": "TX", "Calif.": "CA", "penna": "PA", None: ""}


@pytest.mark.parametrize("fn,cases", [(S.normalize_street, STREETS), (S.normalize_city, CITIES), (S.normalize_state, STATES)])
def test_normalisers(spark, fn, cases):
    assert values(spark, fn, [(k,) for k in cases], "x string") == list(cases.values())


def test_similarity(spark):
    pairs = [("abc", "abc"), ("ABC", "abd"), ("", ""), (None, "x"), ("kitten", "sitting")]
    got = values(spark, S.similarity, pairs, "a string, b string")
    assert got == pytest.approx([1.0, 2 / 3, 1.0, 0.0, 4 / 7])
    assert values(spark, S.trigram_jaccard, [("ab", "ab"), ("abcd", "abce"), (None, "abc")], "a string, b string") == pytest.approx([0.0, 1 / 3, 0.0])


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])]
    assert values(spark, V.cosine, rows, "a array<double>, b array<double>") == pytest.approx([0, 1, 0, 0, 0, 0])


def test_mock_embedding(spark):
    got = values(spark, lambda t: V.mock_embedding(t, 3), [("ab",), (" ",), (None,)], "t string")
    assert got[0] == pytest.approx([math.sin(i + 97 + 98) * 0.1 for i in range(3)]) and got[1:] == [None, None]


PAIRS = [
    ("Person", {"email": "A@b.c"}, {"email": "a@B.C "}, True),
    ("Person", {"phone": "555-0100-12"}, {"phone": "+1 5550100 12"}, True),
    ("Person", {"name": "Ann Alder", "email": "ann@x.org"}, {"name": "Bea Birch", "email": "bea@x.org"}, False),
    ("Person", {"first_name": "Ann", "last_name": "Alder"}, {"name": "A Alder"}, True),
    ("Asset", {"serial_number": "s-1"}, {"serial_number": "S-1"}, True),
    ("Vehicle", {"vin": "1-A 2"}, {"vin": "1a2"}, True),
    ("Asset", {"name": "Zenith Drill X200"}, {"brand": "Zenith", "model": "X200"}, True),
    ("Asset", {"name": "hammer"}, {"name": "ladder"}, False),
    ("Address", {"street": "12 Oak Street", "city": "Rome"}, {"street": "12 Oak St.", "city": "Rome"}, True),
    ("Address", {"street": "12 Oak Street", "city": "Rome", "state": "NY", "postalCode": "10001"}, {"street": "99 Elm Street", "city": "Rome", "state": "NY", "postalCode": "10001"}, False),
    ("Address", {}, {}, False),
    ("Event", {"title": "Yearly meeting"}, {"name": "yearly meeting"}, True),
    ("Event", {}, {}, False),
]


def test_matching_rules(spark):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "k int, t string, a map<string,string>, b map<string,string>, want boolean")
    for t in {p[0] for p in PAIRS}:
        for prepared in (False, True):
            own = df.where(F.col("t") == t)
            if prepared:
                own = own.withColumn("a", M.prepare(F.col("a"))).withColumn("b", M.prepare(F.col("b")))
            for r in own.select("k", "want", M.matches(t, F.col("a"), F.col("b")).alias("m"), M.matches(t, F.col("b"), F.col("a")).alias("w")).collect():
                assert r["m"] == r["want"] == r["w"], PAIRS[r["k"]]


def test_rules_over_prepared_properties_are_short_and_alike(spark):
    maps = spark.createDataFrame([(k, *p[1:3]) for k, p in enumerate(PAIRS)], "k int, a map<string,string>, b map<string,string>")
    own = maps.select("k", M.prepare(F.col("a")).alias("a"), M.prepare(F.col("b")).alias("b"))
    for t in ["Asset"]:
        sides = [[c(x) for x in "ab"] for c in (F.col, M.known)]
        for r in own.select(*[F.array_join(M.fired(t, *x), " ").alias(f"r{n}") for n, x in enumerate(sides)]).collect():
            assert r["r0"] == r["r1"]
    held = own.select(M.fired("Asset", M.known("a"), M.known("b")).alias("r"))
    assert len(held._jdf.queryExecution().analyzed().toString()) < 20_000  # 13,420; what derives brands and models is 25,000 more


def test_pairs_that_matched_carry_no_rules_along(spark):
    nodes = spark.createDataFrame([("a", "Asset", "x", {"serial_number": "1"}), ("b", "Thing", "some name", {"name": "some name"})], "id string, label string, name string, props map<string,string>")
    found = resolve.fuzzy_pairs(nodes, nodes.withColumn("id", F.concat("id", F.lit("0"))))
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["new_id"], r["match_id"]) for r in found.collect()) == [("a", "a0"), ("b", "b0")]


def test_confidence_bounds(spark):
    maps = "a map<string,string>, b map<string,string>"
    rows = [({}, {}), ({"serial_number": "1"}, {"serial_number": "1"}), ({"name": "truck"}, {"name": "truck"}), ({"serial_number": "1", "vin": "2", "name": "x y"}, {"serial_number": "1", "vin": "2", "name": "x y"})]
    got = values(spark, lambda a, b: M.confidence("Asset", a, b), rows, maps)
    assert got[0] == 0 and got[1] == pytest.approx(0.8) and 0 <= got[2] <= 0.5 and 0.9 <= got[3] <= 1
    assert values(spark, M.decision, [(0.95,), (0.9,), (0.5,), (0.3,)], "c double") == ["auto_merge", "auto_merge", "human_review", "auto_reject"]


def test_trigram_join_is_lossless(spark):
    """Names that repeat, in other cases too, short ones and random ones, against all pairs."""
    import random

    rng = random.Random(4)
    names = ["alpha beta", "Alpha Betta", "alpha bet", "gamma", "GAMMA", "gamma", "gammas", "x", "x", None, None, "abc", "abc", "abcd", "abcde", "delta delta", "delta delta1"]
    names += ["".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")

    def grams(s):
        return {s[i : i + 3].lower() for i in range(len(s) - 2)}

    for least in (0.3, 0.5, 0.8):
        want = {}
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                b = names[j]
                if a and b and grams(a) | grams(b) and (score := len(grams(a) & grams(b)) / len(grams(a) | grams(b))) > least:
                    want[i, j] = score
        like = fuzzy.LikeNames(df, least)
        got = [(r["a"], r["b"], r["score"]) for r in like.all_pairs().collect()]
        assert sorted(got) == [(*k, pytest.approx(v)) for k, v in sorted(want.items())]
        top = sorted(want, key=lambda k: (-want[k], k))[:7]
        assert [(r["a"], r["b"]) for r in like.top(7).collect()] == top


def test_name_candidates(spark):
    nodes = spark.createDataFrame([(1, "Org", "Microsoft Corp"), (2, "Org", "Acme"), (3, "Thing", "microscope"), (4, "Org", "ACME "), (5, "Org", "my ox")], "id long, label string, name string")
    asked = spark.createDataFrame([("Micro Systems", "Org"), ("acme", "Org"), ("ox cart", "Org"), ("zz top", "Org"), ("ac", "Org")], "name string, label string")
    assert {(r["name"], r["id"], r["how"]) for r in fuzzy.name_candidates(asked, nodes).collect()} == {("Micro Systems", 1, "word"), ("acme", 2, "exact"), ("acme", 4, "exact"), ("ox cart", 5, "word")}
    free = fuzzy.name_candidates(asked.select("name"), nodes)
    assert {r["id"] for r in free.where("name = 'Micro Systems'").collect()} == {1, 3}
    assert fuzzy.name_candidates(asked, nodes, limit=1).count() == 3


def test_resolution_stages(spark):
    schema = "id string, label string, name string, props map<string,string>"
    old = spark.createDataFrame([("1", "Asset", "drill", {"name": "drill", "serial_number": "S1"}), ("2", "Asset", "saw", {"name": "saw", "unique_tag": "t2"}), ("3", "Thing", "rock", {"kind": "k"})], schema)
    new = spark.createDataFrame([("1", "Asset", "any", {}), ("a", "Asset", "blade", {"unique_tag": "t2"}), ("b", "Asset", "bore", {"serial_number": "s1"}), ("c", "Thing", "stone", {"kind": "k"}), ("d", "Asset", "New one", {}), ("e", "Asset", "new ONE", {})], schema)
    got = {r["new_id"]: (r["match_id"], r["stage"]) for r in resolve.resolve(new, old, ["Asset"]).collect()}
    assert got == {"1": ("1", "constraint"), "a": ("2", "constraint"), "b": ("1", "fuzzy"), "c": ("3", "equality"), "d": ("d", "create"), "e": ("d", "batch")}


def test_index_recall(spark):
    from quillgraph.plans import vectors

    for sf in ("sf0.01", "sf0.1"):
        got = vectors.recall(spark, f"/root/testdata/{sf}", 10).first()
        assert got["recall"] >= 0.9 and got["share"] <= 0.1, (sf, got)


def test_index_of_odd_rows(spark):
    """Nulls, several lengths, more of them than have code books, repeated rows, and nothing at all."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6 if i % 2 else 5).tolist()) for i in range(400)] + [(500 + n, [1.0] * n) for n in range(20, 40)] + [(500 + n + 100, [2.0] * n) for n in range(20, 40)]
    rows += [(900, None), (901, []), (902, [None] * 5), (903, [float("nan")] * 5), (904, [0.0] * 5), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = V.IVF(df)
    exact = {(r["query_id"], r["id"]) for r in V.nearest(df, df, 2).collect()}
    found = [(r["query_id"], r["id"]) for r in index.search(df, 2).collect()]
    assert len(found) == len(set(found)) == len(exact) and len(exact & set(found)) / len(exact) >= 0.9
    assert (520, 620) in found and (539, 639) in found
    none = df.where("false")
    assert V.IVF(none).search(df, 2).isEmpty() and index.search(none, 2).isEmpty() and V.nearest(none, df, 2).isEmpty()


def test_nearest_against_brute_force(spark, monkeypatch):
    """Labels of any type, vectors of unequal length, ties, nulls, and labels of several tiles."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3 + i % 2)], "ab"[i % 3 == 0]) for i in range(80)] + [(80, None, "a"), (81, [], "a"), (82, [0.0, 0.0, 0.0], "a"), (83, [1.0, None, 2.0], "a"), (84, [1.0, float("nan"), 2.0], "a"), (85, [1.0, float("inf"), 2.0], "a"), (86, [1.0, 2.0, 3.0], None)]
    usable = [r for r in rows if r[1] and r[2] and all(x is not None and math.isfinite(x) for x in r[1])]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string").repartition(5)

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = []
    for i, v, lab in usable:
        near = sorted((-round(cosine(v, w), 9), j) for j, w, other in usable if j != i and lab == other and len(v) == len(w) and cosine(v, w) >= -0.5)
        want += [(i, j, r + 1) for r, (_, j) in enumerate(near[:4])]
    for size, fan in ((16 << 20, 64), (500, 2)):
        monkeypatch.setattr(V, "TILE_BYTES", size)
        monkeypatch.setattr(V, "FAN", fan)
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in V.nearest(df, df, 4, least=-0.5, same_label=True).collect()) == sorted(want)


def rule_pairs(rng, label):
    """Nodes of a type with properties that are alike now and then, in every way that a rule knows."""
    pick = lambda *x: x[rng.integers(len(x))]

    def typo(t):
        k = int(rng.integers(len(t) + 1))
        return t[:k] + pick("", "x", "zz") + t[k + 1 :] if rng.random() < 0.5 else t

    p = {}
    if label == "Person":
        first, last = pick("Ann", "Anne", "Bob", "Rob"), typo(pick("Alexandersson", "Birchwoods", "Oldmans"))
        p = pick({"full_name": f"{first} {last}"}, {"first_name": first, "last_name": last}, {"name": typo(f"{first} {last}")}, {"last_name": last})
        p |= pick({}, {"email": pick("a@x.org", "A@x.org ", "b@y.org")}, {"phone": pick("+1 555 010 9988", "5550109988", "0109988")}, {"ssn": pick("1-2", "12", "13")})
    elif label == "Asset":
        p = pick({"name": typo(pick("Zenith drill X200", "hammer", "big ladder 9m"))}, {"brand": typo(pick("Zenith", "Acmetools")), "model": typo(pick("X200-long", "ladder 9m"))}, {"name": "drill zenith x200-long"})
        p |= pick({}, {"vin": pick("1-A", "1a")}, {"serial_number": pick("s1", "S1 ", "t")}, {"barcode": pick("77", "7-7")})
    elif label == "Address":
        p = {"street": typo(pick("12 Oak Street", "12 Oak St.", "Oak Avenue", "99 Elmwood Boulevard", "")), "city": pick("Rome", "Roma"), "state": pick("NY", "New York")}
        p |= pick({}, {"postalCode": pick("10001", "20002")})
    else:
        p = pick({"name": typo("yearly meeting of all")}, {"title": "Yearly Meeting of all"}, {"id": pick("1", "2")}, {})
    return p


def test_candidates_are_written_out_one_by_one(spark):
    """The plan of all candidates holds no joins, and settings that hold while something is written are put back."""
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    x = spark.createDataFrame([("a", {"name": "Truck 1", "vin": "V1"}), ("b", {"name": "Truck 2", "vin": "v-1"})], "id string, p map<string,string>")
    met = blocking.candidates("Asset", x, x)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert ("a", "b") in {tuple(r) for r in met.collect()} and spark.conf.get("spark.sql.maxPlanStringLength") == before


@pytest.mark.parametrize("label", ["Person", "Asset", "Address", "Event"])
def test_candidates_hold_every_pair_a_rule_holds_for(spark, label):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = [(f"{side}{i}", side, rule_pairs(rng, label)) for side in "xy" for i in range(45)]
    df = spark.createDataFrame(rows, "id string, side string, props map<string,string>").select("id", "side", M.prepare(F.col("props")).alias("p")).persist()
    x, y = (df.where(F.col("side") == s).select("id", "p") for s in "xy")
    all_ = x.select(F.col("id").alias("new_id"), F.col("p").alias("a")).crossJoin(y.select(F.col("id").alias("match_id"), F.col("p").alias("b")))
    want = {(r[0], r[1]) for r in all_.select("new_id", "match_id", M.matches(label, F.col("a"), F.col("b")).alias("m")).collect() if r[2]}
    got = {tuple(r) for r in blocking.candidates(label, x, y).collect()}
    assert want and not want - got
    df.unpersist()


def test_like_strings_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    df = spark.createDataFrame([(i, "", w) for i, w in enumerate(words)], "id long, by string, v string")
    for least in (0.6, 0.7, 0.8, 0.85, 0.9):
        all_ = df.select(F.col("id").alias("a"), F.col("v").alias("x")).crossJoin(df.select(F.col("id").alias("b"), F.col("v").alias("y")))
        want = {(r[0], r[1]) for r in all_.where(S.similar(F.col("x"), F.col("y"), least)).select("a", "b").collect()}
        assert {tuple(r) for r in blocking.like(df, df, least).collect()} == want


def test_texts(spark):
    t = "Saw [Ann] and [Entity: Bob ] then [Ann] []"
    assert values(spark, X.mentions, [(t,), (None,)], "t string") == [["Ann", "Bob"], None]
    assert values(spark, X.entity_mentions, [(t,)], "t string") == [["Bob"]]
    assert values(spark, lambda t: X.context(t, F.lit("Ann"), 4), [(t,), ("nobody",)], "t string") == ["aw Ann an", None]
    assert values(spark, lambda t: X.parse_response(t)["description"], [('```json\n{"description":"d"}\n```',), ("{",), (None,)], "t string") == ["d", None, None]
    mime, data = X.data_url(F.col("t"))
    assert [tuple(r) for r in spark.createDataFrame([("data:image/png;base64,QUI=",), ("http://x",)], "t string").select(mime, data.cast("string")).collect()] == [("image/png", "AB"), (None, None)]


def test_names_are_compared_once_and_travel_as_bytes(spark, monkeypatch):
    """nearest_names() finds what nearest() finds among dense embeddings; of the copies of a name one goes to the tiles, as a byte for each n-gram."""
    import numpy as np

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("ab1é"), rng.integers(1, 9)))
    some = [f"{word()} {word()}" for _ in range(40)] + ["Zürich Ltd", "x"]
    form = [str.upper, str.lower, lambda t: f" {t} ", str.title]
    rows = [(i, form[i % 4](some[int(rng.integers(42))])) for i in range(300)] + [(300 + i, "Many Copies") for i in range(500)] + [(900, None), (901, ""), (902, "  ")]
    items = spark.createDataFrame(rows, "id long, name string").repartition(3)
    asked = spark.createDataFrame([(i, n) for i, n in rows[:120]] + [(500, "the many copies"), (501, "many copies"), (502, None), (503, " ")], "id long, name string")
    dense = lambda df: df.select("id", V.ngram_embedding(F.col("name")).alias("vector"))
    got = items.select(V.ngram_embedding(F.col("name")).alias("v"), V.ngram_bytes(F.col("name")).alias("b")).collect()
    assert all((r["b"] is None) == (r["v"] is None) and (r["b"] is None or np.bincount(list(r["b"]), minlength=256).tolist() == r["v"]) for r in got)
    sent, tiles = [], V._tiles
    for least, size in ((0.8, 16 << 20), (0.3, 16 << 10)):
        monkeypatch.setattr(V, "TILE_BYTES", size)
        want = sorted(V.nearest(dense(asked), dense(items), 5, least=least, drop_self=False).collect())
        monkeypatch.setattr(V, "_tiles", lambda q, x, *rest: sent.append((q.count(), x.count(), dict(x.dtypes)["vector"])) or tiles(q, x, *rest))
        assert sorted(V.nearest_names(asked, items, 5, least=least).collect()) == want and len(want) > 300
        monkeypatch.setattr(V, "_tiles", tiles)
    names = {n.strip().lower() for _, n in rows if n and n.strip()}
    assert all(q <= 44 and x == len(names) and kind == "binary" for q, x, kind in sent) and len(sent) == 2
    assert V.nearest_names(asked.where("false"), items, 2).isEmpty() and V.nearest_names(asked, items.where("false"), 2).isEmpty()


def test_verification_requests_make_no_dense_vectors(spark, monkeypatch):
    """J1 and J2 at 60 times sf0.1 lost an executor: 2,160,000 vectors of 2 KB, each sent to eight tasks."""
    from quillgraph.plans import state

    monkeypatch.setattr(V, "ngram_embedding", None)
    asked, near = state.similars(spark, "/root/testdata/sf0.001")
    assert near.select("request_id").distinct().count() > asked.count() / 2


def test_numbered_names_meet_in_packed_parts(spark, monkeypatch, tmp_path):
    """J2 at 60 times sf0.1, where one task read all names to deal them out: numbered names in parts, each sent as one row, find what dense vectors find."""
    asked = spark.createDataFrame([(k, f"Supplier#{k:09d}" + ("", " Ltd", "x")[k % 3]) for k in range(0, 900, 9)] + [(2000, "customer#000000007"), (2001, "Q" * 400)], "id long, name string")
    rows = [(k, f"Supplier#{k:09d}") for k in range(900)] + [(5000 + k, f"Customer#{k:09d}") for k in range(900)] + [(9000 + k, "Supplier#000000001") for k in range(9)] + [(9999, "q" * 300)]
    items = spark.createDataFrame(rows, "id long, name string").repartition(3)
    dense = lambda df: df.select("id", V.ngram_embedding(F.col("name")).alias("vector"))
    packed = V._packed_tiles

    def watched(q, x, meet, schema):
        def noted(a, b):
            with open(tmp_path / str(size), "a") as to:
                to.write(f"{a.num_rows} {b.num_rows}\n")
            return meet(a, b)

        return packed(q, x, noted, schema)

    monkeypatch.setattr(V, "_packed_tiles", watched)
    for least, size in ((0.8, 128 << 10), (0.0, 16 << 20)):
        monkeypatch.setattr(V, "TILE_BYTES", 16 << 20)
        want = sorted(V.nearest(dense(asked), dense(items), 5, least=least, drop_self=False).collect())
        monkeypatch.setattr(V, "TILE_BYTES", size)
        assert sorted(V.nearest_names(asked, items, 5, least=least).collect()) == want and len(want) > 300
    met = [tuple(map(int, x.split())) for x in (tmp_path / str(128 << 10)).read_text().splitlines()]
    assert len(met) == 2 * 4 and sum(n for n, _ in met) == 4 * 102 and sum(n for _, n in met) == 2 * 1801


def test_nearest_by_bytes_is_exact(spark, monkeypatch):
    """Of bytes as of doubles: the same pairs, ranks and similarities, with copies, ties, other lengths, zeros and nulls, whatever the tiles; and a vector takes a byte a component on its way."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(size=24) * (0, 0.002, 0.3)[i % 3]).tolist(), "a" if i % 5 else "b") for i in range(180)]
    rows += [(i, rng.choice([-1.0, 1.0], 24).tolist(), "a") for i in range(200, 230)] + [(i, [1.0, float(i)], "a") for i in range(300, 320)]
    rows += [(400, [0.0] * 24, "a"), (401, None, "a"), (402, [], "a"), (403, [1.0] * 24, None), (404, [float("nan")] * 24, "a")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    q = df.where("id % 3 <> 1")
    want = sorted(tuple(r) for r in V.nearest(q, df, 5, least=0.75, same_label=True, drop_self=False).collect())
    for size in (V.TILE_BYTES, 3000):
        monkeypatch.setattr(V, "TILE_BYTES", size)
        got = sorted(tuple(r) for r in V.nearest_coded(q, df, 5, least=0.75).collect())
        assert got == want and len(got) > 300
    sent = V._coded(V.usable(df, F.col("label")))
    assert sent.where("octet_length(vector) <> split(key, ':')[1] + 8").isEmpty() and not sent.isEmpty()
