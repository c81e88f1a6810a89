"""What a Python worker remembers from task to task, held by one operator at a time.

Workers serve all stages of a session. An operator that begins to use its memory drops that of the
others, so that a worker never holds more than the largest of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_drops: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def register(owner: str, drop: Callable[[], None]) -> None:
    _drops[owner] = drop


def claim(owner: str) -> None:
    """Drop what all owners but this one remember, if another was the last."""
    global _owner
    if _owner != owner:
        for name, drop in _drops.items():
            if name != owner:
                drop()
        _owner = owner
        gc.enable()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)  # what is free goes back to the system
