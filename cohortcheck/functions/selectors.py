"""Column selectors: pick columns of a wide table by name.

A selector works on the list of names only, so the schema decides what a rule covers and no data
is read. Selectors combine with ``&``, ``|`` and ``~``; names are compared without case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Selector:
    """A predicate over column names, with an optional list of names that must exist."""

    def __init__(self, accepts: Callable[[str], bool], label: str, required: Iterable[str] = ()):
        self._accepts = accepts
        self.label = label
        self.required = tuple(required)

    def __call__(self, columns: Iterable[str]) -> list[str]:
        """The selected names, in table order."""
        names = list(columns)
        present = {name.lower() for name in names}
        absent = [name for name in self.required if name.lower() not in present]
        if absent:
            raise ValueError(f"missing required column(s): {', '.join(absent)}")
        return [name for name in names if self._accepts(name.lower())]

    def __and__(self, other: Selector) -> Selector:
        return Selector(
            lambda n: self._accepts(n) and other._accepts(n),
            f"({self.label} & {other.label})",
            self.required + other.required,
        )

    def __or__(self, other: Selector) -> Selector:
        return Selector(
            lambda n: self._accepts(n) or other._accepts(n),
            f"({self.label} | {other.label})",
            self.required + other.required,
        )

    def __invert__(self) -> Selector:
        return Selector(lambda n: not self._accepts(n), f"~{self.label}")

    def __repr__(self) -> str:
        return self.label


def contains(part: str) -> Selector:
    """Names that contain ``part``."""
    return Selector(lambda n: part.lower() in n, f"contains({part!r})")


def any_of(*names: str) -> Selector:
    """Those of ``names`` that exist."""
    wanted = {name.lower() for name in names}
    return Selector(lambda n: n in wanted, f"any_of({', '.join(names)})")


def column(*names: str) -> Selector:
    """Exactly ``names``; it is an error when one is absent."""
    wanted = {name.lower() for name in names}
    return Selector(lambda n: n in wanted, ", ".join(names), names)


def everything() -> Selector:
    """Every column."""
    return Selector(lambda n: True, "everything()")
