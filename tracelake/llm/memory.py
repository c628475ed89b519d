"""What a reused Python worker gives back before it runs another operator."""

from __future__ import annotations

import ctypes
import gc

#: Caches that outlive a task, by what they serve.
CACHES: list[dict] = []


def cache() -> dict:
    """A dict that lasts as long as its worker, or until another operator's task runs there."""
    CACHES.append({})
    return CACHES[-1]


def release(keep: dict | None = None) -> None:
    """Empty all caches but one and hand freed memory back to the system."""
    held = False
    for known in CACHES:
        if known is not keep and known:
            known.clear()
            held = True
    if held:
        gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
