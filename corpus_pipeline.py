"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of its
predecessor; the result is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import decontam, labelled, minhash, packing, quality, secrets
from curatrix.session import drop_scratch, scratch_scope, ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from two of three folds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(labelled.fold(3) != 1)
    return quality.keep_quality(docs, labels, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of five-word shingles: the smallest ``doc_id``, one without an id last.

    A document is a ``doc_id`` with a text: exact repeats stay once, unlike texts
    under one ``doc_id`` all count.  Rows with neither stay.  An empty table gives
    no rows.
    """
    return minhash.drop_duplicates(docs, shingle=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those mostly made of them go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_share=0.5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by marks."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048.

    Workers still hold what earlier stages left, so the encoder remembers less.
    """
    return packing.pack_documents(docs, end_id=0, size=2048, include_ids=False, cached=600_000)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages), ("secrets", redact_secrets), ("packing", pack)]

#: Trained classifiers, tokenizers and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents`` of ``sf_dir``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch_scope(spark) as result:
            docs = result(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_scratch(before)  # the next stage's table is whole
        before = docs
    return docs
