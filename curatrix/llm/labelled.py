"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import zlib
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers import this module and need no pandas
    import pandas as pd


def fold(modulus: int) -> Column:
    """crc32 of the decimal ``doc_id`` modulo ``modulus``; a null one reads as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, text_bytes: int) -> pd.DataFrame:
    """Up to ``rows // 2`` texts of each class, chosen by a hash of ``doc_id``: columns ``text, y``.

    ``labels`` holds the rows that may be learned from.  Texts over
    ``text_bytes`` are not learned from (they are scored like any other), and of
    the texts of a repeated id the first in order is, so the driver gets ``rows``
    texts and ``rows * text_bytes`` bytes at most.  Null ids and labels are left
    out; of unlike labels of one id the largest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id")
    chosen = known.where("y = 1").orderBy(order).limit(rows // 2).unionByName(known.where("y = 0").orderBy(order).limit(rows // 2))
    ids = docs.sparkSession.createDataFrame(chosen.toPandas().astype({"doc_id": "int64", "y": "int32"}), "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.where(F.octet_length("text") <= text_bytes).join(F.broadcast(ids), "doc_id")  # at most ``rows`` ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values(["doc_id", "text"], ignore_index=True)[["text", "y"]]
