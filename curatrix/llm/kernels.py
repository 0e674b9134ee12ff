"""Vectorised text kernels shared by the corpus operators.

They read Arrow string buffers directly: no Python object is made per document
or per word.  Blocks are bounded by bytes, so memory follows the longest single
document rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII capitals become small letters; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: 1 for bytes of words that any byte but ASCII white space makes up.
GRAPHIC = np.ones(256, np.uint8)
GRAPHIC[[9, 10, 11, 12, 13, 32]] = 0

#: 1 for bytes of words made of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, np.uint8)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = 1

#: 1 for letters, 2 for digits, 3 for other signs: tokens end where the class changes.
SHAPES = np.where(GRAPHIC == 0, 0, 3).astype(np.uint8)
SHAPES[65:91] = SHAPES[97:123] = SHAPES[128:] = 1
SHAPES[48:58] = 2

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[FOLD]
_STEP = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        for k, step in enumerate((_STEP, inverse)):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def release() -> None:
    """Give the power tables back; the next use builds them anew."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Block(NamedTuple):
    """Adjacent texts of one Arrow batch: rows ``first`` to ``first + len(bounds) - 1``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a block: byte spans, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or binary column into blocks of at most ``limit`` bytes (or one text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Block(lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def pieces(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = 256) -> Iterator[tuple[int, list]]:
    """Adjacent rows as Python values, with the number of the first one: at most ``rows`` and ``limit`` bytes (or one row) at a time."""
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    lo = 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), n)
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def words(block: Block, classes: np.ndarray) -> Words:
    """Spans of maximal runs of one non-zero class, never across two texts."""
    kind = classes[block.data]
    n = len(kind)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.bounds), np.int64))
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[block.bounds] = True
    edge = np.flatnonzero(change)
    inside = kind[edge[:-1]] != 0
    start, end = edge[:-1][inside], edge[1:][inside]
    return Words(start, end, np.searchsorted(start, block.bounds))


def word_hashes(block: Block, w: Words) -> np.ndarray:
    """64-bit hash of each word, capitals folded."""
    n = len(block.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[block.data] * power[:n], out=total[1:])
    return mix64((total[w.end] - total[w.start]) * inverse[w.start] + (w.end - w.start).astype(np.uint64))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of one text's words.

    Fewer words than ``width`` make one shingle of the whole sequence; no words
    make none.
    """
    if not len(h):
        return h
    width = min(width, len(h))
    x = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        x = mix64(x) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(mix64(x))
