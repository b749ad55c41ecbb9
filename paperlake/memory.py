"""Memory of Python workers."""

import ctypes

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system, also while something is kept: a worker waits for its next
    task beside later stages' memory."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
