"""What a Python worker remembers from task to task belongs to one operator at a time.

Spark keeps its workers, so what the operators of a pipeline remember would add up. The
operator whose turn it is takes over: what others have is dropped, and the memory goes back
to the system.
"""

from __future__ import annotations

import ctypes
import gc

_held: dict[str, dict] = {}


def of(operator: str) -> dict:
    """What this worker remembers for an operator; that of all others goes."""
    others = [held for name, held in _held.items() if name != operator and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library, which does so by itself
            pass
    return _held.setdefault(operator, {})
