"""Front ends of languages and other sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Modules = Callable[[SparkSession, str, tuple[str, ...]], DataFrame]
_LANGUAGES: dict[str, Modules] = {}


def register_language(name: str, modules: Modules) -> None:
    """Add a front end: (spark, root, exclude) -> one row per source file."""
    _LANGUAGES[name] = modules


def language(name: str) -> Modules:
    _builtin()
    if name not in _LANGUAGES:
        raise KeyError(f"no language {name!r}; there are {', '.join(languages())}")
    return _LANGUAGES[name]


def languages() -> list[str]:
    _builtin()
    return sorted(_LANGUAGES)


def _builtin() -> None:
    from . import java_source, python_source, typescript_source

    for name, m in (("java", java_source), ("python", python_source), ("typescript", typescript_source)):
        _LANGUAGES.setdefault(name, m.modules)
