"""Compiled patterns, kept by their text: the regex module's own cache costs more than most searches here."""

from __future__ import annotations

from functools import lru_cache

import regex


@lru_cache(maxsize=None)
def rx(pattern: str, flags: int = 0) -> regex.Pattern:
    """Patterns are literals of this package, so their number is fixed."""
    return regex.compile(pattern, flags)
