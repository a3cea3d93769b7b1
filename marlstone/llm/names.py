"""Column names for internal use that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Each of `wanted`, with underscores before it until it differs from all `columns` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: Iterable[str], name: str) -> list[str]:
    """`columns` but for `name`, in any case."""
    return [c for c in columns if c.lower() != name.lower()]
