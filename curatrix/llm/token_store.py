"""Token ids as Parquet list columns, ordered and selectively readable.

Files hold ``part, doc_id, part_start, n_tokens, ids`` in ascending ``doc_id``
order.  ``ids`` is dictionary encoded (a vocabulary below 2**17 packs into 16
or 17 bits a token); the scalar columns skip the dictionary, so that version 2
pages store them as deltas.  Row groups and pages are bounded, and the writer
adds page indexes: a reader that wants a few documents, or metadata alone,
touches only those pages and columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curatrix.llm import kernels as K
from curatrix.llm.tokens import Encoder, encoded, ended
from curatrix.session import scratch_path, ship_package

SCHEMA = "part int, doc_id long, part_start long, n_tokens int, ids array<int>"


def layout(row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 2000) -> dict[str, str]:
    """Options of the Parquet writer that give the files their layout."""
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")}
    return plain | {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }


def _emit(end_id: int) -> Callable:
    def bind(enc: Encoder) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, start = TaskContext.get().partitionId(), 0
            for batch in batches:
                for block in K.blocks(batch.column(1)):
                    ids, edge = ended(*enc.encode_block(block), end_id)
                    size = np.diff(edge)
                    column = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.view(np.int32)))
                    arrays = [pa.array(np.full(len(size), part, np.int32)), batch.column(0).slice(block.first, len(size)), pa.array(start + edge[:-1]), pa.array(size.astype(np.int32)), column]
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "part_start", "n_tokens", "ids"])
                    start += int(edge[-1])

        return run

    return bind


def write_tokens(docs: DataFrame, path: str | None = None, *, tokenizer: str | None = None, end_id: int = 1, **sizes: int) -> str:
    """Encode ``text`` of ``docs``, append ``end_id`` to each, write the files; returns their folder.

    Null texts count as empty and so hold ``end_id`` alone.  Rows are ordered by
    ``doc_id`` (null first), repeated ids by a hash of their text, repeated rows
    as they come; each is stored.  An id that very many rows repeat, or lack, is
    spread over tasks by those further keys.  An empty table gives a folder
    without rows.  Other columns are ignored, whatever their names.  Texts are
    encoded a bounded number of bytes at a time, or one by one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.col("_hash"), F.col("_place")]
    keyed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded(ordered.select("doc_id", "text"), tokenizer, _emit(end_id), SCHEMA).write.options(**layout(**sizes)).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; Spark prunes columns and skips row groups and pages by ``doc_id``."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids of all documents before each one.

    Only the columns ``part`` and ``n_tokens`` are read for the offsets of the
    parts.  There is one row for each writing task, which bounds the broadcast.
    """
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_offset"))
    return tokens.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("part_offset")).drop("part_offset")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from ``with_starts``: size and checksum of the ids as stored."""
    ship_package(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            edge = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
