"""What a Python worker does besides its task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory back to the system, so that a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # the C library of another system
        pass
