"""Keeping tables up to date from streams (an extension: batch results stay the definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from curatrix.functions import vectors as V
from curatrix.operators.index import SimilarityIndex


def maintain_index(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append micro-batches of ``stream(id, embedding, ...)`` below ``path``; ``current_index`` merges them.

    A batch writes its own rows only, under ``batch=<batch id>``; one that is
    tried again writes the same folder over.  ``compact_index`` bounds the folders.
    """

    def step(batch: DataFrame, number: int) -> None:
        have = set(batch.columns)
        kind = batch.schema["id"].dataType
        own = [F.col(c) if c in have else (F.col("id") if c == "sample_id" else F.lit(None).cast(kind)).alias(c) for c in ("sample_id", "label_id")]
        rows = batch.select("id", *own, (F.col("pos") if "pos" in have else F.lit(None)).cast("long").alias("pos"), V.vector("embedding").alias("embedding"), F.monotonically_increasing_id().alias("place"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def current_index(spark: SparkSession, path: str, **options) -> SimilarityIndex:
    """The index after all batches so far: an id's row is that of its last batch, its position that of its first."""
    rows = spark.read.parquet(path).where("id is not null and embedding is not null")
    at = F.struct("batch", "place")
    last = F.max_by(F.struct("sample_id", "label_id", "embedding"), at).alias("r")
    first = F.coalesce(F.min("pos"), F.min(F.col("batch").cast("long"))).alias("pos")
    return SimilarityIndex(rows.groupBy("id").agg(last, first).select("id", "r.sample_id", "r.label_id", "pos", "r.embedding"), **options)


def compact_index(spark: SparkSession, path: str, before: int) -> None:
    """Merge the batches below ``before`` into one; none of them may be written meanwhile.

    The merged rows are written beside the batches first; then the old folders go
    and the new one takes the place of the last of them.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at(path)) if s.getPath().getName().startswith("batch="))
    old = [n for n in old if n < before]
    if len(old) < 2:
        return
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in old])
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch", "pos")]), F.struct("batch", "place")).alias("r")
    merged = rows.groupBy("id").agg(last, F.coalesce(F.min("pos"), F.min(F.col("batch").cast("long"))).alias("pos"))
    merged.select("id", "r.sample_id", "r.label_id", "pos", "r.embedding", "r.place").write.mode("overwrite").parquet(f"{path}-compacted")
    for n in old:
        fs.delete(at(f"{path}/batch={n}"), True)
    fs.rename(at(f"{path}-compacted"), at(f"{path}/batch={old[-1]}"))


def tumbling_counts(events: DataFrame, *, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``key, start, n`` of tumbling windows; on a stream, windows close ``late`` behind the newest event."""
    kind = events.schema[ts].dataType
    # Watermarks need timestamps with a zone; the result has the events' own type again.
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").cast(kind).alias("start"), "n")
