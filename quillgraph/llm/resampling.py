"""Importance resampling towards a target distribution, in DataFrame functions only.

The features of a text are its runs of one to three words, hashed to buckets by CRC-32. The gain of a
bucket is how much more often the target texts have it than the corpus, as a logarithm; the weight of
a document is the sum of the gains of its features. Gumbel noise from a hash of the id turns the largest
scores into a draw without replacement in proportion to exp(weight / 1000).

The features are made once and written out. Their counts are summed before the shuffle, so it has
one row for each bucket and task; the table of gains has as many rows as there are buckets and goes to
every task; the sums of a document shuffle one row each. Ranks need no task that sees all rows: the
documents are dealt by ranges of the score, sorted within each, and a row's rank is its place there plus
the sizes of the parts before.

Defined cases: a null text has no words, as an empty one or one of separators alone: weight 0, never
drawn. A null id is hashed as the text 'null' and comes last among equal scores. Rows of equal
score and id (repeated rows too) are ranked one by one, in any order. A very long text is one row of as
many short numbers as it has features. Without documents the result is empty, without target texts every
gain is that of a target of no features. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of the table of gains, which goes to every task.
BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Of a hundred documents that could be drawn.
PERCENT = 5
SEED = 42
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, _SEPARATORS), lambda w: w != "")


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def features(w: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of one to three words of an array of words, repeats included."""
    from_second, from_third = F.slice(w, 2, F.size(w)), F.slice(w, 3, F.size(w))
    one = F.transform(w, lambda x: _bucket(x, buckets))
    two = F.transform(from_second, lambda y, i: _bucket(F.concat(F.get(w, i), F.lit(" "), y), buckets))
    three = F.transform(from_third, lambda z, i: _bucket(F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), z), buckets))
    return F.concat(one, two, three)


def counts(featured: DataFrame, n: str) -> DataFrame:
    """bucket and how many features it has, of rows with `buckets`."""
    return featured.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(n))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln of the smoothed target share over the smoothed corpus share)."""
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(counts(corpus, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    of = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return both.join(F.broadcast(of)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))  # of is one row


def noise(ident: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the id's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, wanted: Column, *order: Column) -> DataFrame:
    """rows with rank (1, 2, ... in the given order) of those that are wanted; null for the others.

    A global sort: dealt by ranges, sorted within each part, written; then the sizes of the parts before
    (a row for each part) are added.
    """
    first = F.when(wanted, 0).otherwise(1)
    dealt = rows.repartitionByRange(first, *order).sortWithinPartitions(first, *order)
    placed = materialize(dealt.withColumn("at", F.monotonically_increasing_id()))  # part << 33 | place within it
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return out.withColumn("rank", F.when(wanted, F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)).drop("at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; the rank is null where it is not drawn.

    docs: doc_id, text; target: text. Of the N documents of least_words words or more the
    floor(percent * N / 100) with the highest scores are drawn, ties to the smaller id.
    """
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    made = w.select("doc_id", F.size("w").cast("long").alias("n_words"), features(F.col("w"), buckets).cast("array<smallint>" if buckets <= 1 << 15 else "array<int>").alias("buckets"))
    featured = materialize(made.withColumn("row", F.monotonically_increasing_id()))
    # Written too: else Spark would push a test for empty arrays below the words, which are then split anew for each of them.
    wanted = materialize(target.select(words(F.col("text")).alias("w")).select(features(F.col("w"), buckets).alias("buckets")))
    table = F.broadcast(gains(featured, wanted, buckets))  # `buckets` rows
    each = featured.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = each.join(table, "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    long_enough = F.col("n_words") >= least_words
    out = ranked(scored, long_enough, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    drawn = featured.agg(F.floor(F.count_if(long_enough) * percent / 100).alias("k")).scalar()
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


#: The same rows in DuckDB. CRC-32 is computed byte by byte there, for each distinct feature.
ORACLE_SQL = f"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
worded AS MATERIALIZED (SELECT side, row, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
each_ AS (SELECT side, row, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS c FROM worded),
runs AS (SELECT side, row, a AS f FROM each_ UNION ALL SELECT side, row, a || ' ' || b FROM each_ WHERE b IS NOT NULL UNION ALL SELECT side, row, a || ' ' || b || ' ' || c FROM each_ WHERE c IS NOT NULL),
per AS MATERIALIZED (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per)),
summed AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h), 2), lambda j: ('0x' || substr(h, j, 2))::BIGINT)),
  lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1])), 4294967295) % {BUCKETS} AS bucket FROM hexed, tab),
bucketed AS MATERIALIZED (SELECT side, row, bucket, sum(n) AS n FROM per JOIN summed USING (f) GROUP BY ALL),
tally AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM bucketed GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM tally),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + {BUCKETS}))::DOUBLE / ((s + 1) * (all_t + {BUCKETS}))::DOUBLE))::BIGINT AS g FROM tally, totals),
weighed AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT d.row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM worded d LEFT JOIN weighed USING (row) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS r, (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r::BIGINT END AS rank FROM placed
"""
