"""Pieces of SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def ref(name: str) -> str:
    """A column by name."""
    return "`" + name.replace("`", "``") + "`"


def quoted(value: str | None) -> str:
    """A text literal, or a null of type text."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(value: str, allowed: Iterable[str]) -> str:
    """Membership; null if ``value`` is null."""
    return f"{value} IN ({', '.join(quoted(a) for a in allowed)})"


def holds(cond: str) -> str:
    """``cond``, with an undecided outcome as false."""
    return f"coalesce({cond}, false)"


def any_true(conds: Iterable[str]) -> str:
    """Does one of the conditions hold?"""
    return "(" + " OR ".join([*[f"({c})" for c in conds]] or ["false"]) + ")"


def array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"
