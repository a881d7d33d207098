"""The corpus pipeline: five stages, each of them one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases, of each stage: an empty table gives an empty one with the same columns. A null or empty
text is scored like any other by the quality filter, is in no class of copies, loses nothing, and holds
no benchmark passage. Rows of a null id have no class, neither lose nor cost anything in the suffix-array
stage, and are judged by their own text elsewhere. Repeated rows of one id are judged row by row, but
go together as copies. Columns beside doc_id, text and source pass through whatever their names; n_chars
follows the text that is cut. A document of which the suffix-array stage leaves nothing stays, with the
empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bagminhash, decontam, mixing, quality, suffix_dedup
from quillgraph.llm.common import materialize, table, tune


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    tune(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest id."""
    tune(spark)
    return bagminhash.dedup(docs)


def exact_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats an earlier document for 50 bytes or more is cut out of the texts."""
    tune(spark)
    return suffix_dedup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    tune(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate has it, shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("exact_substrings", exact_substrings),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The stages are models, sketches and suffix arrays: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
