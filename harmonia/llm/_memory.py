"""Arrow tasks that give back what they held: workers outlive their tasks and would keep it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Tables from this size on are worth a release after each group.
LARGE = 1 << 22


def release() -> None:
    """Return unused memory of Arrow's pool and, where the C library can, of the heap to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, with a release at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean_groups(run: Callable[[tuple, pa.Table], pa.Table]):
    """``run`` for ``applyInArrow``, with a release after each large group."""

    def wrapped(key: tuple, table: pa.Table) -> pa.Table:
        large = table.nbytes >= LARGE
        out = run(key, table)
        if large:
            del table
            release()
        return out

    return wrapped
