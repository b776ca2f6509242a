"""Training corpus from ``documents``: judged, cleaned of toxic texts, deduplicated, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockml.llm import nbsvm, toxicity
from blockml.llm.exact_dedup import exact_dedup
from blockml.llm.jaccard_join import keep_one_of_near
from blockml.llm.packing import pack
from blockml.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null, empty and wordless texts go; repeated rows share
    one verdict; without labels of both kinds every text with a word stays."""
    return nbsvm.reject_low_quality(docs, nbsvm.fit_on_labels(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Null and empty texts stay; repeated rows share one verdict; without
    labels of both kinds all stay."""
    return toxicity.reject_toxic(docs, toxicity.fit_on_labels(spark, sf_dir))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest doc_id (null last). Null texts stay; repeated rows
    become one."""
    return exact_dedup(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Null keys, null texts and
    texts without a word stay."""
    return keep_one_of_near(docs, n=3, threshold=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a bin for every piece of every document; null and empty texts have none. Rows with equal or
    null keys are packed each for itself."""
    return pack(docs, capacity=8192)


STAGES = [("quality_classifier", quality), ("toxicity", clean), ("exact_dedup", once), ("ngram_jaccard_join", apart), ("best_fit_packing", packed)]

#: The classifiers are trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. Every stage gives an empty table
    for an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
