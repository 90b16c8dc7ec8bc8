"""Document comparison on Spark, and operators of a training-data pipeline."""

from __future__ import annotations

import importlib

_HOME = {"ComparisonError": "options", "Limits": "options", "Options": "options"}
__all__ = [
    "ComparisonError", "Limits", "Options", "compare", "compare_images", "compare_runs", "compare_set", "is_equal", "normalize_text",
    "pair_pages", "render_preview", "revisions",
]


def __getattr__(name: str):
    """The entry points of ``api``, imported when they are first used."""
    if name not in __all__:
        raise AttributeError(name)
    return getattr(importlib.import_module(f".{_HOME.get(name, 'api')}", __name__), name)
