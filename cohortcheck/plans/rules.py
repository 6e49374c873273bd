"""Rule kinds. A rule names what is wrong and lists the findings it may make on a row.

Conditions and values are SQL expressions. They reach cells through the context, which knows
whether a subject owns one row or several.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from cohortcheck.functions import Selector, array, one_of, quoted, ref, text_of
from cohortcheck.functions.parsing import BLANK_CLASS, trimmed
from cohortcheck.operators.normalize import Layout
from cohortcheck.operators.reshape import SlotFamily
from cohortcheck.plans.contexts import Context, Previous, RowContext, SubjectContext

AnyContext = RowContext | SubjectContext

# From so many cells on, a rule about cells goes through them as an array; fewer are findings of their own.
FEW_CELLS = 8


@dataclass(frozen=True)
class Finding:
    """One possible violation on a row: when it happens, and the cells to show.

    All parts are expressions; the columns are text expressions that name the shown cells.
    """

    when: str
    column1: str
    value1: str
    column2: str | None = None
    value2: str | None = None


@dataclass(frozen=True)
class EachFinding:
    """A possible violation of each element of an array; ``finding`` is about ``element``, by that name."""

    items: str
    element: str
    finding: Finding

    @property
    def when(self) -> str:
        return self.finding.when


@dataclass(frozen=True)
class Rule:
    """Base of all rules: a stable id, a long text and a short one."""

    rule_id: str
    description: str
    short_message: str

    def findings(self, ctx: AnyContext) -> list[Finding | EachFinding]:
        raise NotImplementedError


@dataclass(frozen=True)
class KeyPresentRule(Rule):
    """The subject key must be a number; checked on the rows that normalising would drop."""

    def keyless(self, layout: Layout) -> Finding:
        return Finding("true", quoted(layout.subject), ref(layout.raw_key))

    def findings(self, ctx: AnyContext) -> list[Finding]:
        return []


@dataclass(frozen=True)
class KeyUniqueRule(Rule):
    """A subject must own one row; every row of a repeated key is reported."""

    def findings(self, ctx: AnyContext) -> list[Finding]:
        key = ctx.layout.subject
        return [Finding(ctx.is_repeated(), quoted(key), ctx.text(key))]


@dataclass(frozen=True)
class CellRule(Rule):
    """Each selected cell must hold one of ``allowed``; an empty cell passes."""

    selector: Selector
    allowed: tuple[str, ...]

    def findings(self, ctx: AnyContext) -> list[Finding | EachFinding]:
        names = self.selector(ctx.columns)
        if len(names) < FEW_CELLS:
            return [
                Finding(f"NOT {one_of(ctx.text(name), self.allowed)}", quoted(name), ctx.text(name)) for name in names
            ]
        cells = array(f"named_struct('name', {quoted(name)}, 'text', {ctx.text(name)})" for name in names)
        bad = Finding(f"NOT {one_of('_cell.text', self.allowed)}", "_cell.name", "_cell.text")
        return [EachFinding(cells, "_cell", bad)]


@dataclass(frozen=True)
class CodeListRule(Rule):
    """Each code of a selected comma-list cell must be one of ``allowed``; one violation per bad code.

    The cell is tested with one pattern. Only cells that fail are split, after the violations have
    been singled out (see :meth:`bad_code`).
    """

    selector: Selector
    allowed: tuple[str, ...]

    def findings(self, ctx: AnyContext) -> list[Finding]:
        code = rf"{BLANK_CLASS}*(?:{'|'.join(self.allowed)}){BLANK_CLASS}*"
        whole = quoted(f"^{code}(?:,{code})*$")
        return [
            Finding(f"NOT {ctx.text(name)} RLIKE {whole}", quoted(name), ctx.text(name))
            for name in self.selector(ctx.columns)
        ]

    def bad_code(self, code: str) -> str:
        return f"rule_id = {quoted(self.rule_id)} AND NOT {one_of(trimmed(code), self.allowed)}"


@dataclass(frozen=True)
class SlotRule(Rule):
    """``check(ctx, cells, previous)`` on each slot of a family.

    ``cells`` maps fields to expressions, ``previous`` is the slot before. ``show`` lists the one or
    two fields to report; ``"<date"`` is the field of the slot before. A rule that shows no such
    field gets no ``previous``. Slots without a value in the field ``needs`` pass; they are left out once for all such rules.
    """

    family: SlotFamily
    check: Callable[[Context, dict[str, str], Previous | None], str]
    show: tuple[str, ...]
    needs: str | None = None

    def findings(self, ctx: AnyContext) -> list[EachFinding]:
        looks_back = any(f.startswith("<") for f in self.show)
        if looks_back:
            items, slot = ctx.pairs(self.family, self.needs), "_slot.s"
        else:
            items, slot = ctx.with_field(ctx.slots(self.family), self.needs), "_slot"
        previous = Previous.of("_slot.b", self.family) if looks_back else None
        cells = {f: f"{slot}.{f}" for f in self.family.fields}
        shown: list[str] = []
        for f in self.show:
            if f.startswith("<"):
                shown += [previous.names[f[1:]], previous.texts[f[1:]]]
            else:
                shown += [f"{slot}.{f}_name", text_of(cells[f], self.family.fields[f])]
        bad = self.check(ctx, cells, previous)
        return [EachFinding(items, "_slot", Finding(f"_slot.b IS NOT NULL AND ({bad})" if looks_back else bad, *shown))]


@dataclass(frozen=True)
class Bound:
    """Allowed days since the slot before, for a given code of that slot.

    ``codes`` are the codes it applies to, or None for a slot without a code. With ``after_index``
    it applies only after that slot, to any code but ``codes``.
    """

    codes: tuple[str, ...] | None
    earliest: int
    latest: int
    after_index: int | None = None

    def applies(self, previous: Previous, field: str) -> str:
        code = previous.values[field]
        if self.after_index is not None:
            return f"{previous.index} = {self.after_index} AND NOT {one_of(code, self.codes)}"
        return f"{code} IS NULL" if self.codes is None else one_of(code, self.codes)


def interval_rule(
    rule_id: str,
    description: str,
    short_message: str,
    family: SlotFamily,
    side: str,
    bounds: tuple[Bound, ...],
    exempt: tuple[str, ...] = (),
    day: str = "date",
    code: str = "dose",
) -> SlotRule:
    """The days since the slot before must not be beyond the first bound that applies.

    ``side`` is ``late`` or ``early``; slots whose own code is in ``exempt`` pass.
    """

    def outside(ctx: Context, cells: dict[str, str], previous: Previous) -> str:
        days = f"datediff({cells[day]}, {previous.values[day]})"
        branches = [f"WHEN {one_of(cells[code], exempt)} THEN false"] if exempt else []
        for bound in bounds:
            wrong = f"> {bound.latest}" if side == "late" else f"< {bound.earliest}"
            branches.append(f"WHEN {bound.applies(previous, code)} THEN {days} {wrong}")
        return f"CASE {' '.join(branches)} ELSE false END"

    return SlotRule(rule_id, description, short_message, family, outside, (f"<{day}", day), needs=day)


@dataclass(frozen=True)
class SubjectRule(Rule):
    """Any other rule: ``make(ctx)`` returns its findings."""

    make: Callable[[AnyContext], list[Finding]]

    def findings(self, ctx: AnyContext) -> list[Finding]:
        return self.make(ctx)
