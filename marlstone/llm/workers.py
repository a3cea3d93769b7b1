"""Memory of reused Python workers.

A worker process outlives a stage, and with it tables that an operator keeps between its
tasks. `batches` marks which operator runs now; when another one starts in the same worker,
what the one before keeps is dropped and free memory goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

_current: list[tuple[str, Callable[[], object] | None]] = []


def trim() -> None:
    """Give unused memory back to the system, where the C library can."""
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batches(operator: str, incoming: Iterable, release: Callable[[], object] | None = None) -> Iterator:
    """The batches of one task of `operator`; `release` drops what the operator keeps
    between its tasks. Once they are read, free memory goes back to the system."""
    if _current and _current[0][0] != operator:
        held = _current.pop()[1]
        if held is not None:
            held()
        gc.collect()
        trim()
    if not _current:
        _current.append((operator, release))
    yield from incoming
    trim()
