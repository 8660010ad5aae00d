"""Memory of Python workers, which Spark keeps and uses again for later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Memory that Arrow and the C library keep of what was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; behind its last batch the memory that Arrow holds unused goes back to the system.

    An idle worker would keep it beside the heap of the JVM, while later stages sort and join there.
    """

    def returned(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return returned
