"""What a Python worker keeps between tasks: one large object at a time.

Workers are reused by tasks of all stages, so what one operator keeps would weigh on every later one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_held: dict[object, object] = {}
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def keep[T](key: object, make: Callable[[], T]) -> T:
    """The object made under this key, from an earlier task if it was the last one kept."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives what is kept back to the system."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc: freed memory stays with the process
            pass


def fresh(run: Run) -> Run:
    """run, for a task that needs nothing kept."""

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)

    return started
