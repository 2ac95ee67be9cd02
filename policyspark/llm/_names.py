"""Column names of our own that don't clash with a caller's."""

from __future__ import annotations


def unused(taken: list[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, each with so many underscores before it that none of ``taken`` is like it, in any case of letters."""
    known = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def unused_prefix(taken: list[str], wanted: str = "q") -> str:
    """``wanted``, with so many underscores before it that no name in ``taken`` begins with it."""
    while any(t.lower().startswith(wanted.lower()) for t in taken):
        wanted = "_" + wanted
    return wanted
