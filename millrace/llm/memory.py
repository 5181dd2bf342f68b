"""Python workers stay alive between tasks; what they freed is given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import textgrid as tg


def release() -> None:
    """Drops tables that are quickly made again, and returns free memory of Arrow's
    pool and of the C library to the system."""
    tg.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal() -> None:
    """Makes the C library give memory back early: threads of native libraries share
    two arenas, and large arrays are returned as soon as they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-8, 2), (-3, 4 << 20), (-1, 8 << 20)):  # arenas, mmap and trim thresholds
            libc.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """run, with its free memory given back early, and all of it when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator:
        frugal()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
