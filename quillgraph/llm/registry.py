"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, clustering, decontam, langid, licenses, maxproduct, mixing, mpegts, ppm, quality, resampling, suffix_dedup, toxicity
from .common import fold, table, tune


def _held_out(k: int):
    return F.coalesce(fold("doc_id", k) == 2, F.lit(False)).alias("held_out")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(4), "score", "predicted")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.judge(found).withColumn("hits", F.to_json("hits"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", _held_out(4), "lang_pred", "score")


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mpegts.decode(mpegts.encode(table(spark, sf_dir, "documents"))).drop("breaks", "pts", "random_access")


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    scored = ppm.score(docs, ppm.training(docs))
    return scored.select("doc_id", _held_out(7), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(4), "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return maxproduct.search(table(spark, sf_dir, "embeddings"), F.col("id") % maxproduct.EVERY == 0)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return clustering.cluster(table(spark, sf_dir, "embeddings")).assigned().withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.ORACLE_SQL, "op11_importance_resampling": resampling.ORACLE_SQL, "op12_exact_topk_search": maxproduct.ORACLE_SQL, "op13_centroid_clustering": clustering.ORACLE_SQL}
