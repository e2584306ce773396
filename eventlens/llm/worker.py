"""State that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

KEPT = "_eventlens_llm_kept"


def kept(key: tuple, make: Callable):
    """What `make()` gave the first time this worker asked for `key`; used for models and vocabularies."""
    store = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
