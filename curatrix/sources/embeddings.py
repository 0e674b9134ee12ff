"""Where vectors come from: fields, tables, arrays, indexes and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators.index import SimilarityIndex
from curatrix.session import ship_package


def from_field(samples: DataFrame, id_col: str, field: str) -> DataFrame:
    """``id, embedding`` of rows with a vector in ``field`` (dots reach into structs)."""
    return samples.where(F.col(field).isNotNull()).select(F.col(id_col).alias("id"), V.vector(field).alias("embedding"))


def from_labels(samples: DataFrame, id_col: str, labels: str, field: str = "embedding") -> DataFrame:
    """``sample_id, id, idx, embedding`` of labels with a vector; others go before the list is unnested."""
    kept = samples.select(F.col(id_col).alias("sample_id"), F.filter(labels, lambda x: x[field].isNotNull()).alias("_l"))
    return kept.select("sample_id", F.posexplode("_l").alias("idx", "_x")).select("sample_id", F.col("_x.id").alias("id"), "idx", V.vector(F.col(f"_x.{field}")).alias("embedding"))


def from_values(spark: SparkSession, samples: DataFrame, id_col: str, values: dict) -> DataFrame:
    """``id, embedding`` of samples that ``values`` (id to vector) has; others are left out."""
    kind = samples.schema[id_col].dataType.simpleString()
    given = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in values.items() if v is not None], f"id {kind}, embedding array<double>")
    return samples.select(F.col(id_col).alias("id")).join(given, "id")


def from_index(samples: DataFrame, id_col: str, index: SimilarityIndex) -> DataFrame:
    return index.base.join(samples.select(F.col(id_col).alias("id")), "id", "left_semi").select("id", "embedding")


def from_model(samples: DataFrame, id_col: str, content: str, load: Callable[[], Callable[[list], list]], *, skip_failures: bool = True, batch: int = 1024) -> DataFrame:
    """``id, embedding`` by a model that each task loads once; ``model(contents)`` returns a vector or None for each.

    Failed batches are tried row by row; rows that fail give no vector, or raise
    unless failures may be skipped.
    """
    ship_package(samples.sparkSession)
    kind = samples.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    out = model(part["content"].tolist())
                except Exception:
                    if not skip_failures:
                        raise
                    out = []
                    for x in part["content"]:
                        try:
                            out += model([x])
                        except Exception:  # noqa: BLE001  one sample's failure is its own
                            out.append(None)
                yield pd.DataFrame({"id": part["id"], "embedding": [None if v is None else [float(x) for x in v] for v in out]}).dropna(subset=["embedding"])

    return samples.select(F.col(id_col).alias("id"), F.col(content).alias("content")).mapInPandas(run, f"id {kind}, embedding array<double>")


def empty(spark: SparkSession, kind: str = "long") -> DataFrame:
    return spark.createDataFrame([], f"id {kind}, embedding array<double>")


def resolve(samples: DataFrame, id_col: str, *, index: SimilarityIndex | None = None, model: Callable | None = None, content: str | None = None, field: str | None = None, values: dict | None = None) -> DataFrame:
    """The first source given, in this order: index, model, field, values; none gives no rows."""
    if index is not None:
        return from_index(samples, id_col, index)
    if model is not None:
        return from_model(samples, id_col, content, model)
    if field is not None:
        return from_field(samples, id_col, field)
    if values is not None:
        return from_values(samples.sparkSession, samples, id_col, values)
    return empty(samples.sparkSession, samples.schema[id_col].dataType.simpleString())


def file_hashes(spark: SparkSession, path: str, method: str = "sha256") -> DataFrame:
    """``path, length, hash`` of all files below ``path``; unreadable files are skipped by the reader's own option."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    h = {"md5": F.md5("content"), "sha256": F.sha2("content", 256), "xxhash64": F.xxhash64("content").cast("string")}[method]
    return files.select("path", "length", h.alias("hash"))
