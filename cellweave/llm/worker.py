"""What a Python worker process keeps between tasks: one tool at a time.

Workers live on from stage to stage. A tokenizer or a table of scores that an earlier stage built goes before the next
one is made, so that the memory of a worker is that of its present stage.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

Tool = TypeVar("Tool")
_held: dict[Hashable, object] = {}


def release() -> None:
    """Let go of the tool and give its pages back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass


def held(key: Hashable, make: Callable[[], Tool]) -> Tool:
    """The tool of this key, made if another one or none is held."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]
