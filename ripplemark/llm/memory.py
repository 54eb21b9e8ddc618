"""What a Python worker keeps between tasks.

Workers stay for later tasks, and Spark hands the idle ones out in turn, so an executor
holds more of them than it has cores.  Allocators keep what a task has freed: without
:func:`lean`, each idle worker goes on holding about as much as its largest task needed.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable
from functools import cache, wraps

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's way to hand its free pages back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Hands free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(function: Callable) -> Callable:
    """``function``, over batches or over one group's table; what it freed is handed back when it ends."""
    if inspect.isgeneratorfunction(function):

        @wraps(function)
        def over_batches(batches):
            try:
                yield from function(batches)
            finally:
                give_back()

        return over_batches

    @wraps(function)
    def over_group(table):
        try:
            return function(table)
        finally:
            give_back()

    return over_group
