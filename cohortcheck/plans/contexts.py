"""What a rule may ask about a row and about the other rows of its subject.

A rule is written once, as SQL expressions over a context. Nearly every subject owns one row; for
those, :class:`RowContext` answers every question from the row itself, so that all rules become
plain expressions in a single pass without a shuffle. For subjects with several rows,
:class:`SubjectContext` answers with columns that an aggregation over the subject, and the row
before, have supplied.

The slots of a family are data: one column holds them as an array of structs, and rules look at its elements. So the
text of a rule is as long for forty slots as for two; only the array itself names every column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcheck.functions import array, holds, quoted, ref, text_of
from cohortcheck.operators.keys import FIRST_ROW, LAST_ROW, N_ROWS
from cohortcheck.operators.neighbours import PREVIOUS
from cohortcheck.operators.normalize import Layout
from cohortcheck.operators.reshape import SlotFamily, index_of
from cohortcheck.plans.settings import Settings

LAST, FIRSTS = "_last", "_firsts"
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FACT, _SLOTS, _PAIRS = "_fact", "_slots", "_pairs"
# Room for the places of one question among the keys of ``FIRSTS``.
_PLACES = 1_000_000


@dataclass(frozen=True)
class Previous:
    """The slot before a slot, in slot order within the subject: its number, and per field the
    value, the column name and the value as report text, all as expressions."""

    index: str
    values: dict[str, str]
    names: dict[str, str]
    texts: dict[str, str]

    @classmethod
    def of(cls, element: str, family: SlotFamily) -> Previous:
        """Read off an element of a slot array."""
        values = {f: f"{element}.{f}" for f in family.fields}
        texts = {f: text_of(values[f], kind) for f, kind in family.fields.items()}
        return cls(f"{element}.index", values, {f: f"{element}.{f}_name" for f in family.fields}, texts)


@dataclass
class Context:
    """Access to the cells of a row. ``used`` collects the columns that rules asked for."""

    types: dict[str, str]
    layout: Layout
    settings: Settings
    used: set[str] = field(default_factory=set)
    computed: dict[str, int] = field(default_factory=dict)
    arrays: list[str] = field(default_factory=list)
    paired: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.layout.cells(list(self.types))

    def col(self, name: str | None, dtype: str = "string") -> str:
        """A cell, or a typed null when the table has no such column."""
        found = self.real(name)
        if found is None:
            return f"CAST(NULL AS {dtype})"
        self.used.add(found)
        return ref(found)

    def real(self, name: str | None) -> str | None:
        """The table's own spelling of a name; names are compared without case."""
        if name is None or name in self.types:
            return name
        return next((c for c in self.types if c.lower() == name.lower()), None)

    def text(self, name: str | None) -> str:
        """A cell as report text."""
        return text_of(self.col(name), self.types.get(self.real(name), "string"))

    def slots(self, family: SlotFamily) -> str:
        """A column with the slots of a family: an array of structs in slot order, with the ``place`` in it, the ``index``, the
        ``event`` if the family has events, and each field with its ``…_name``, the column that it is in."""
        slots = family.slots(self.columns)
        dtype = family.index_type(slots)
        # The array is made where all columns are, so they need not be carried along for it.
        used = set(self.used)
        entries = []
        for place, slot in enumerate(slots):
            parts = [f"'place', {place}", f"'index', {index_of(slot, dtype)}"]
            parts += [f"'event', {quoted(slot.event)}"] if family.events else []
            for f, kind in family.fields.items():
                parts += [f"'{f}', {self._typed(slot.column(f), kind)}", f"'{f}_name', {quoted(family.shown(slot, f))}"]
            entries.append(f"named_struct({', '.join(parts)})")
        if not entries:
            fields = ["place int", "index int", *(["event string"] if family.events else [])]
            fields += [f"{f} {kind}, {f}_name string" for f, kind in family.fields.items()]
            entries = [f"from_json('{{}}', '{', '.join(fields)}')"]
        self.used = used
        value = array(entries) if slots else f"filter({array(entries)}, _e -> false)"
        if value not in self.arrays:
            self.arrays.append(value)
        return f"{_SLOTS}{self.arrays.index(value)}"

    def _typed(self, name: str | None, kind: str) -> str:
        """A cell as a field of that type; texts as the report shows them."""
        if name is None:
            return f"CAST(NULL AS {kind})"
        return self.text(name) if kind == "string" else f"CAST({self.col(name)} AS {kind})"

    def with_slots(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` of ``rows``, and the slot arrays as further columns, where ``rows`` have none yet."""
        missing = [(i, value) for i, value in enumerate(self.arrays) if f"{_SLOTS}{i}" not in rows.columns]
        return rows.selectExpr(*keep, *[f"{value} AS {_SLOTS}{i}" for i, value in missing])

    def with_field(self, slots: str, name: str | None) -> str:
        """A column with the slots that have a value in the field ``name``; all of them without a name."""
        return slots if name is None else self.fact(f"filter({slots}, _e -> _e.{name} IS NOT NULL)")

    def _pair(self, slots: str, before: str) -> str:
        """A column with an array of ``s``, a slot, and ``b``, the slot before; ``before`` is about the slot ``_s``."""
        value = f"transform({slots}, _s -> named_struct('s', _s, 'b', {before}))"
        if value not in self.paired:
            self.paired.append(value)
        return f"{_PAIRS}{self.paired.index(value)}"

    def fact(self, value: str) -> str:
        """A value of the row that many findings ask for: computed once per row, as a column.

        A fact may build on other facts. The text of a finding then does not grow with what its facts are made of.
        """
        if value not in self.computed:
            levels = list(self.computed.values())
            below = [levels[int(n)] for n in re.findall(rf"{_FACT}(\d+)\b", value)]
            self.computed[value] = max(below, default=-1) + 1
        return f"{_FACT}{list(self.computed).index(value)}"

    def with_pairs(self, rows: DataFrame) -> DataFrame:
        """``rows``, which must have what is known of their neighbours, with the pairs of slots as further columns."""
        return rows.selectExpr("*", *[f"{value} AS {_PAIRS}{i}" for i, value in enumerate(self.paired)])

    def with_facts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the facts as further columns, one projection per level."""
        named = [(level, f"{value} AS {_FACT}{i}") for i, (value, level) in enumerate(self.computed.items())]
        for level in range(max(self.computed.values(), default=-1) + 1):
            rows = rows.selectExpr("*", *[text for at, text in named if at == level])
        return rows

    def future(self, day: str) -> str:
        return holds(f"{day} > DATE '{self.settings.as_of.isoformat()}'")

    def too_early(self, day: str) -> str:
        return holds(f"{day} < DATE '{self.settings.not_before.isoformat()}'")


@dataclass
class RowContext(Context):
    """For subjects with one row: the row is the group."""

    def any(self, cond: str) -> str:
        """Does ``cond`` hold on some row of the subject?"""
        return self.fact(holds(cond))

    def max(self, value: str) -> str:
        """The largest ``value`` over the rows of the subject."""
        return self.fact(value)

    def last(self, candidates: str) -> str:
        """Field ``outcome`` of the largest struct of an array, over all rows of the subject."""
        return self.fact(f"array_max({candidates}).outcome")

    def on_first(self, cond: str) -> str:
        """True on the first row of the subject for which ``cond`` holds."""
        return holds(cond)

    def once(self, cond: str) -> str:
        """True on the first row of the subject, if the subject-wide ``cond`` holds."""
        return holds(cond)

    def is_repeated(self) -> str:
        """Does the subject own several rows?"""
        return "false"

    def pairs(self, family: SlotFamily, needs: str | None = None) -> str:
        """The slots of a family (those with a value in the field ``needs``), each with the one before it, whatever that holds
        (null for the first)."""
        slots = self.slots(family)
        return self._pair(self.with_field(slots, needs), f"get({slots}, _s.place - 1)")

    def first_at(self, places: str) -> Callable[[str], str]:
        """``places`` lists slots of the row for which something holds. The result tells of a place whether this is the
        first row of the subject on which it does."""
        return lambda place: f"array_contains({places}, {place})"

    def checked(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the table with all that findings ask for."""
        return self.with_pairs(self.with_facts(self.with_slots(rows, ["*"])))


@dataclass
class SubjectContext(Context):
    """For subjects with several rows; gathers the aggregates and neighbour cells to supply."""

    aggregates: list[str] = field(default_factory=list)
    carried: list[str] = field(default_factory=list)
    by_place: list[str] = field(default_factory=list)
    grouped: bool = False

    def _aggregate(self, value: str) -> str:
        self.grouped = True
        if value not in self.aggregates:
            self.aggregates.append(value)
        return f"_s{self.aggregates.index(value)}"

    def any(self, cond: str) -> str:
        return self._aggregate(f"bool_or({holds(cond)})")

    def max(self, value: str) -> str:
        return self._aggregate(f"max({value})")

    def last(self, candidates: str) -> str:
        if self.types[self.layout.row] not in _WHOLE:
            return self._aggregate(f"max(array_max({candidates}))") + ".outcome"
        # Fields in their order as digits of one number, which a hash aggregate can keep; a struct would be sorted.
        top = self.fact(f"array_max({candidates})")
        verdict = f"CASE {top}.outcome WHEN true THEN 2 WHEN false THEN 1 ELSE 0 END"
        day = f"coalesce(datediff({top}.day, DATE '1970-01-01') + 2147483648L, 0L)"
        fields = [(day, 10), (f"CAST({top}.row AS DECIMAL(20,0)) + 9223372036854775808", 20), (f"{top}.place", 5), (verdict, 1)]
        number = f"CAST({top}.undated AS INT)"
        for value, digits in fields:
            number = f"(CAST({number} AS DECIMAL(38,0)) * {10**digits} + CAST({value} AS DECIMAL(38,0)))"
        digit = f"{self._aggregate(f'max(CASE WHEN {top} IS NOT NULL THEN CAST({number} AS DECIMAL(38,0)) END)')} % 10"
        return f"(CASE {digit} WHEN 2 THEN true WHEN 1 THEN false END)"

    def on_first(self, cond: str) -> str:
        row = ref(self.layout.row)
        return holds(f"{row} = {self._aggregate(f'min(CASE WHEN {cond} THEN {row} END)')}")

    def once(self, cond: str) -> str:
        self.grouped = True
        return f"({holds(cond)} AND {self._on_first_row()})"

    def is_repeated(self) -> str:
        self.grouped = True
        return "true"

    def pairs(self, family: SlotFamily, needs: str | None = None) -> str:
        """Slots are ordered by number and then by row. So on a later row the slot before is the same one of
        the row before; on the first row, the slot before of the subject's last row."""
        self.grouped = True
        slots = self.slots(family)
        if slots not in self.carried:
            self.carried.append(slots)
        on_first, on_later = f"get({LAST}.{slots}, _s.place - 1)", f"get({PREVIOUS}.{slots}, _s.place)"
        return self._pair(self.with_field(slots, needs), f"CASE WHEN {self._on_first_row()} THEN {on_first} ELSE {on_later} END")

    def first_at(self, places: str) -> Callable[[str], str]:
        self.grouped = True
        if places not in self.by_place:
            self.by_place.append(places)
        base = self.by_place.index(places) * _PLACES
        return lambda place: holds(f"try_element_at({FIRSTS}, {base} + {place}) = {ref(self.layout.row)}")

    def _on_first_row(self) -> str:
        return f"{ref(self.layout.row)} = {FIRST_ROW}"

    def about_subjects(self, rows: DataFrame) -> DataFrame:
        """One record per subject: its row count, the aggregates, and its last row if needed.

        ``rows`` carry the last row id of their subject, so the last row is one that a filter finds; rows are not sorted
        for it.
        """
        keys, row = self.layout.keys, ref(self.layout.row)
        first = f"count_if({row} = {FIRST_ROW})"
        message = f"raise_error('{self.layout.row}: rows of a subject need ids that differ')"
        counted = f"CASE WHEN {first} > 1 THEN {message} ELSE count(1) END"
        wanted = [f"{counted} AS {N_ROWS}", *[f"{value} AS _s{i}" for i, value in enumerate(self.aggregates)]]
        rows = self.with_slots(rows, ["*"])
        known = self.with_facts(rows)
        out = known.groupBy(*keys).agg(*[F.expr(w) for w in wanted])
        if self.by_place:
            # First rows by question and slot, then one map per subject, of at most as many entries.
            marks = [f"transform({places}, _p -> {i * _PLACES} + _p)" for i, places in enumerate(self.by_place)]
            marked = known.selectExpr(*map(ref, keys), row, f"explode(concat({', '.join(marks)})) AS _mark")
            firsts = marked.groupBy(*keys, "_mark").agg(F.expr(f"min({row}) AS _first"))
            firsts = firsts.groupBy(*keys).agg(F.expr(f"map_from_entries(collect_list(struct(_mark, _first))) AS {FIRSTS}"))
            out = out.join(firsts, keys, "left")
        if self.carried:
            carried = ", ".join(ref(c) for c in self.carried)
            last = rows.where(f"{row} = {LAST_ROW}").selectExpr(*map(ref, keys), f"struct({carried}) AS {LAST}")
            out = out.join(last, keys)
        return out
