"""Memory of the Python workers, which Spark keeps between tasks, stages and queries."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[str, Any] = {}


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What ``owner`` keeps in this worker from task to task, made at its first one.

    A worker keeps this for one owner at a time: turning to another drops the last one's.
    """
    if owner not in _kept:
        _kept.clear()
        give_back()
        _kept[owner] = make()
    return _kept[owner]


def turn_to(owner: str) -> None:
    """Drop what other owners keep in this worker; ``owner`` itself keeps nothing."""
    kept(owner, lambda: None)


def give_back() -> None:
    """Return free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
