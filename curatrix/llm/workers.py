"""What a Python worker keeps between tasks.

Workers outlive tasks and stages.  Tables that help later tasks of one operator
(vocabularies, automata, index vectors) would pile up over a pipeline's stages,
so a worker keeps those of one operator at a time, and every task gives freed
memory back to the system when it ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_held: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, release: Callable[[], None]) -> None:
    """Let ``owner`` keep tables here; what another owner kept is released."""
    if _held and _held[0][0] == owner:
        return
    for _, free in _held:
        free()
    _held[:] = [(owner, release)]
    gc.collect()  # tables may refer to themselves
    tidy()


def tidy() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def task(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], release: Callable[[], None]) -> Callable:
    """``run`` as a task of ``owner`` for ``mapInArrow``."""

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner, release)
        try:
            yield from run(batches)
        finally:
            tidy()

    return guarded
