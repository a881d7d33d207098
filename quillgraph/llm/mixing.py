"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document is repeated k times, where k inverts the Poisson distribution whose mean is the
repetition rate of its source at a uniform number taken from a hash of the id and the seed. The
rate of a source is target share x size of the result / documents of the source. All copies are
then dealt out by a second hash and sorted by it: a global shuffle that any rerun repeats exactly.

Defined cases: a null source is a source of its own; repeated rows of one id are repeated alike,
each; a row of a null id is drawn and dealt by its text; a very long text goes as it is; a source without a target has the rate 0; empty in,
empty out; a column of the input that is named copy or mix_key is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Without given targets a source weighs as its documents to this power (1: as it is, 0: all alike).
TEMPERATURE = 0.5
#: Rows of the result for each row of the input, on average.
EPOCHS = 1.0
SEED = 17
#: Probabilities of all sources together (8 bytes each) up to which they go to every task; beyond, sources are joined with salt.
SENT = 1 << 20
#: Parts that a source's documents are dealt to in that join.
SALT = 64
_BITS = 2**52


def uniform(key: Column) -> Column:
    """In [0, 1): the first 13 hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(_BITS))


def rates(docs: DataFrame, targets: DataFrame | None = None, epochs: float = EPOCHS) -> DataFrame:
    """mix_source, rate and the Poisson distribution function cdf (as far as doubles tell it from 1) of each source.

    targets: (source, weight), any positive scale.
    """
    per = docs.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        per = per.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        t = targets.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.sum("weight").cast("double").alias("w"))
        per = per.join(t, "mix_source", "left").na.fill(0.0, ["w"])
    all_n, all_w = per.agg(F.sum("n")).scalar(), per.agg(F.nullif(F.sum("w"), F.lit(0.0))).scalar()
    rate = F.coalesce(F.col("w") / all_w * all_n * F.lit(epochs) / F.col("n"), F.lit(0.0))
    # The state of the fold: logarithm of the next probability, sum so far, list of sums.
    last = F.ceil(F.col("rate") + 12 * F.sqrt(F.col("rate")) + 20).cast("int")
    start = F.struct((-F.col("rate")).alias("lp"), F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("cdf"))

    def add(a: Column, k: Column) -> Column:
        s = a["s"] + F.exp(a["lp"])
        lp = a["lp"] + F.log(F.col("rate")) - F.log(k + 1.0)
        return F.struct(lp.alias("lp"), s.alias("s"), F.concat(a["cdf"], F.array(s)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), last), start, add, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))
    return per.select("mix_source", rate.alias("rate")).withColumn("cdf", cdf)


def with_rates(rows: DataFrame, per: DataFrame, sent: int = SENT) -> DataFrame:
    """rows (mix_source, ident, ...) with the cdf of their source; documents are never shuffled by source alone."""
    per = materialize(per)
    if per.agg(F.coalesce(F.sum(F.size("cdf")), F.lit(0))).first()[0] <= sent:
        return rows.join(F.broadcast(per), "mix_source")
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALT)).cast("int")).join(salted, ["mix_source", "salt"]).drop("salt")


def mix(docs: DataFrame, targets: DataFrame | None = None, epochs: float = EPOCHS, seed: int = SEED, sent: int = SENT) -> DataFrame:
    """The columns of docs, copy (from 0) and mix_key, by which the rows are shuffled."""
    own = [c for c in docs.columns if c not in ("copy", "mix_key")]
    ident = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))))
    # The row goes as one struct, so that no column of it can clash with those added here.
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in own]).alias("row"), ident.alias("ident"), F.coalesce(docs["source"], F.lit("")).alias("mix_source"))
    u = uniform(F.concat_ws(":", F.lit("u"), F.lit(str(seed)), "ident"))
    key = F.md5(F.concat_ws(":", F.lit("k"), F.lit(str(seed)), "ident", F.col("copy").cast("string")).cast("binary"))
    out = (
        with_rates(rows, rates(docs, targets, epochs), sent)
        .withColumn("mix_n", F.size(F.filter("cdf", lambda c: c <= u)))
        .where("mix_n > 0")
        .select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)).alias("copy"))
        .select("row", "copy", key.alias("mix_key"))
    )
    return out.repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", "copy", "mix_key")


_IDENT_SQL = "coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))"
#: The same rows in DuckDB, for the default targets and parameters.
ORACLE_SQL = f"""
WITH per AS (SELECT coalesce(source, '') AS mix_source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY 1),
rated AS (SELECT mix_source, w / (SELECT sum(w) FROM per) * (SELECT sum(n) FROM per) * {EPOCHS} / n AS rate FROM per),
probs AS (SELECT mix_source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p, rate FROM rated, (SELECT unnest(range(0, 400)) AS k)
          WHERE k <= ceil(rate + 12 * sqrt(rate) + 20)),
cdfs AS (SELECT mix_source, k, sum(p) OVER (PARTITION BY mix_source ORDER BY k) AS c FROM probs),
lists AS (SELECT mix_source, list(c ORDER BY k) AS cdf FROM cdfs GROUP BY 1),
drawn AS (SELECT d.*, ('0x' || substr(md5('u:{SEED}:' || {_IDENT_SQL}), 1, 13))::BIGINT::DOUBLE / {_BITS}.0 AS u,
                 cdf FROM documents d JOIN lists l ON coalesce(d.source, '') = l.mix_source),
counted AS (SELECT * EXCLUDE (u, cdf), len(list_filter(cdf, lambda x: x <= u)) AS mix_n FROM drawn)
SELECT * EXCLUDE (mix_n, c), c::INTEGER AS copy, md5('k:{SEED}:' || {_IDENT_SQL} || ':' || c) AS mix_key
FROM (SELECT *, unnest(range(0, mix_n)) AS c FROM counted)
"""
