"""What a Python worker holds once a task is done. Workers serve one task after another, of any stage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free back to the system; allocators keep it otherwise, and idle workers with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that works as run does; before it, the worker lets go what forget names, and after it, what is free."""

    @functools.wraps(run)
    def lean(batches: Iterator) -> Iterator:
        if forget:
            for each in forget:
                each()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return lean
