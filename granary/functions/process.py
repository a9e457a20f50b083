"""State that a Python worker keeps between tasks."""

from __future__ import annotations


def process_cache() -> dict:
    """One dictionary per Python process. Kernels travel by value, so their own globals start anew in every task."""
    import sys
    from types import ModuleType

    holder = sys.modules.setdefault("_granary_process_cache", ModuleType("_granary_process_cache"))
    return holder.__dict__.setdefault("entries", {})
