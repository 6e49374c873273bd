"""Wide to long: repeated slots and comma lists."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortcheck.functions import Selector, array, quoted, ref
from cohortcheck.functions.parsing import trimmed

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def key_number(key: str) -> int | float | None:
    """The number that a slot key stands for, or None for a key of other text (``baseline``)."""
    if not _NUMBER.fullmatch(key):
        return None
    value = float(key)
    if not math.isfinite(value):
        return None
    return int(value) if value.is_integer() else value


@dataclass(frozen=True)
class Slot:
    """One repetition of a group of columns: its key as the names spell it, the number that the key is, if it is one, and
    the column behind each field."""

    key: str
    columns: dict[str, str]
    event: str | None = None

    @property
    def index(self) -> int | float | None:
        return key_number(self.key)

    def column(self, field: str) -> str | None:
        return self.columns.get(field)


@dataclass(frozen=True)
class SlotFamily:
    """A repeated group, told by a name template such as ``shot{index}_{field}``.

    ``fields`` gives the type of each field. ``{event}`` in the template stands for one of ``events``, ``{index}`` for a key
    that matches ``keys``: digits, or with ``.*`` any text. Names that contain a part in ``without`` are no slots, whatever
    their form. A slot may lack some fields.
    """

    template: str
    fields: dict[str, str]
    events: tuple[str, ...] = ()
    keys: str = r"\d+"
    without: tuple[str, ...] = ()

    def name(self, key: int | str, field: str, event: str | None = None) -> str:
        return self.template.format(index=key, field=field, event=event)

    def shown(self, slot: Slot, field: str) -> str:
        """The column of a slot's field, or what it would be called if the table has none."""
        return slot.column(field) or self.name(slot.key, field, slot.event)

    def slots(self, columns: list[str]) -> list[Slot]:
        """The slots of a table, by event in declared order and then by number.

        Keys that are no number come last, in the order of the table. Spellings of one number (``1`` and ``01``) are slots
        of their own, so that neither hides the other; the shorter one comes first.
        """
        pattern = re.escape(self.template)
        for part, regex in (
            ("index", f"(?P<index>{self.keys})"),
            ("field", f"(?P<field>{'|'.join(self.fields)})"),
            ("event", f"(?P<event>{'|'.join(self.events)})"),
        ):
            pattern = pattern.replace(re.escape("{" + part + "}"), regex)
        found: dict[tuple[int, str], tuple[str, dict[str, str]]] = {}
        for name in columns:
            match = re.fullmatch(pattern, name, re.IGNORECASE | re.DOTALL)
            if match and not any(part.lower() in name.lower() for part in self.without):
                parts = match.groupdict()
                event = self.events.index(parts["event"].lower()) if self.events else 0
                _, named = found.setdefault((event, parts["index"].lower()), (parts["index"], {}))
                named[parts["field"].lower()] = name

        def place(at: tuple[int, str]) -> tuple:
            number = key_number(at[1])
            # Sorting keeps the order of what compares equal.
            return (at[0], True, 0, 0) if number is None else (at[0], False, number, len(at[1]))

        return [Slot(*found[at], self.events[at[0]] if self.events else None) for at in sorted(found, key=place)]

    def index_type(self, slots: list[Slot]) -> str:
        """``int``, unless a number among the keys has a fraction or is too long for one."""
        numbers = [s.index for s in slots if s.index is not None]
        return "int" if all(isinstance(n, int) and abs(n) < 1 << 31 for n in numbers) else "double"


def index_of(slot: Slot, dtype: str) -> str:
    """The number of a slot as an expression, null if its key is none."""
    number = "NULL" if slot.index is None else repr(slot.index) if dtype == "int" else f"{float(slot.index)!r}D"
    return f"CAST({number} AS {dtype})"


def to_long(df: DataFrame, family: SlotFamily, keep: list[str], keys: bool = False) -> DataFrame:
    """One row per input row and slot, with ``keep`` (expressions) carried along; empty slots stay.

    ``index`` is the number of the slot, null for a key that is none, and of type int unless a number has a fraction;
    with ``keys`` the key itself follows as ``slot``. The slots are read off the column names, so the output schema does not
    depend on data, and Spark prunes the columns that no slot uses from the scan.
    """
    slots = family.slots(df.columns)
    dtype = family.index_type(slots)
    entries = []
    for slot in slots:
        parts = [f"'event', {quoted(slot.event)}"] if family.events else []
        parts.append(f"'index', {index_of(slot, dtype)}")
        if keys:
            parts.append(f"'slot', {quoted(slot.key)}")
        for field, kind in family.fields.items():
            name = slot.column(field)
            parts.append(f"'{field}', CAST({ref(name) if name else 'NULL'} AS {kind})")
        entries.append(f"named_struct({', '.join(parts)})")
    if not entries:
        fields = ["event string"] if family.events else []
        fields += ["index int", *(["slot string"] if keys else []), *[f"{f} {t}" for f, t in family.fields.items()]]
        return df.selectExpr(*keep, f"inline(from_json('[]', 'array<struct<{','.join(fields)}>>'))")
    return df.selectExpr(*keep, f"inline({array(entries)})")


def explode_codes(df: DataFrame, selector: Selector, keep: list[str], separator: str = ",") -> DataFrame:
    """One row per code of each selected comma-list cell: ``column, value, position, code``.

    Codes are trimmed; an empty code (as in ``1,,2``) is a row of its own.
    """
    reserved = {k.lower() for k in keep}
    names = [c for c in selector(df.columns) if c.lower() not in reserved]
    cells = [f"named_struct('column', {quoted(c)}, 'value', {ref(c)})" for c in names]
    none = "named_struct('column', CAST(NULL AS STRING), 'value', CAST(NULL AS STRING))"
    return (
        df.selectExpr(*keep, f"inline({array(cells or [none])})")
        .where("value IS NOT NULL")
        .selectExpr("*", f"posexplode(split(value, {quoted(re.escape(separator))})) AS (position, code)")
        .selectExpr(*keep, "column", "value", "position", f"{trimmed('code')} AS code")
    )
