"""Names for an operator's own columns beside those of a caller's table."""

from __future__ import annotations


def own_prefix(columns: list[str], base: str = "__own") -> str:
    """A prefix that no column starts with, whatever the case."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(base) for c in taken):
        base += "_"
    return base
