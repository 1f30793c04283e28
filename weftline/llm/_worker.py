"""What a Python worker keeps between tasks: the tables of one kernel at a time.

Spark gives a worker to stage after stage, so a cache that outlives its own
stage would count against the memory of all that follow on that executor.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[str, Any] = {}
#: of the system's C library, if it has it
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of that name, made on first use; those of other names go."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drop what is kept and give the memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: the Arrow pool and malloc hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
