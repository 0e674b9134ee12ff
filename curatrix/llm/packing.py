"""Best-fit packing of token pieces into training sequences, online and in bounded space.

Documents are encoded where they are read and cut only where they exceed the
sequence length.  Pieces of full length are sequences of their own; the others
are dealt at random to a few tasks, each of which packs its stream online: a
fixed number of open bins is indexed by a bitset over free space, a piece goes
to the open bin whose free space is the smallest that holds it, and when a new
bin would exceed the bound the fullest open one closes.  A task's memory is that
of its open bins, whatever the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm.tokens import CACHED, Encoder, encoded, ended
from curatrix.session import drop_scratch, materialize, ship_package

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class BestFit:
    """Online best fit over at most ``bins`` open bins of ``size`` units."""

    def __init__(self, size: int, bins: int) -> None:
        self.size, self.bins = size, bins
        self._bits = 0
        self._open = 0
        self._by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece of ``length``, 1 to ``size`` units."""
        fit = self._bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            stack = self._by_free[free]
            number = stack.pop()
            if not stack:
                self._bits &= ~(1 << free)
            self._open -= 1
        else:
            free, number = self.size, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self._open >= self.bins:
                fullest = (self._bits & -self._bits).bit_length() - 1
                stack = self._by_free[fullest]
                stack.pop()
                if not stack:
                    self._bits &= ~(1 << fullest)
                self._open -= 1
            self._by_free[left].append(number)
            self._bits |= 1 << left
            self._open += 1
        return number, self.size - free


def _cut(end_id: int, size: int, keep_ids: bool) -> Callable:
    """Map texts to pieces of at most ``size`` ids, each with a number of its own."""

    def bind(enc: Encoder) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 40
            for batch in batches:
                for block in K.blocks(batch.column(1)):
                    ids, edge = ended(*enc.encode_block(block), end_id)
                    many = -(-np.diff(edge) // size)
                    row = np.repeat(np.arange(len(many)), many)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    lo = edge[row] + piece * size
                    hi = np.minimum(lo + size, edge[row + 1])
                    raw = memoryview(ids).cast("B")
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    columns = [batch.column(0).slice(block.first, len(many)).take(pa.array(row)), piece.astype(np.int32), piece * size, (hi - lo).astype(np.int32), crc, number + np.arange(len(row))]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    arrays, names = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_number"]
                    number += len(row)
                    if keep_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.append(lo, edge[-1]), pa.int32()), pa.array(ids.view(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return run

    return bind


def _pack(size: int, bins: int) -> Callable:
    """Append sequence_id and offset to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, fit = TaskContext.get().partitionId() << 40, BestFit(size, bins)
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            arrays = [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, size: int = 2048, bins: int = 4096, rows_per_task: int = 200_000, include_ids: bool = True, cached: int = CACHED) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Each document is its ids and then ``end_id``; null texts count as empty and
    hold ``end_id`` alone.  ``sequence_id`` numbers are unique, not gapless;
    offsets of a sequence's pieces are gapless from 0.  Repeated rows are packed
    each on their own, rows without ``doc_id`` too; pieces are dealt to tasks by
    a number of their own, so they need not differ.  An empty table gives no
    rows.  Other columns are ignored, whatever their names.  Texts are encoded a
    bounded number of bytes at a time, or one by one.  ``cached`` bounds the words
    that a worker remembers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = f"{PIECES}, _number long" + (", ids array<int>" if include_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(encoded(rows, tokenizer, _cut(end_id, size, include_ids), schema, cached), "pieces")
    tasks = max(1, -(-pieces.count() // rows_per_task))
    # A random order, and the same each time.
    order = F.xxhash64("_number")
    placed = pieces.repartition(tasks, order).sortWithinPartitions(order).drop("_number").mapInArrow(_pack(size, bins), f"{PIECES}{', ids array<int>' if include_ids else ''}, sequence_id long, offset int")
    out = materialize(placed, "packed")
    drop_scratch(pieces)
    return out
