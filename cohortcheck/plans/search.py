"""Filters on the columns of a report, as people type them into the boxes above a table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from cohortcheck.functions import any_true, one_of, quoted, ref
from cohortcheck.plans.validation import Pack

_RANGE = re.compile(r"\s*(\S+)?\s*\.\.\.\s*(\S+)?\s*")
_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


@dataclass(frozen=True)
class Between:
    """From ``low`` to ``high``, both included; None leaves a side open. Numbers or dates."""

    low: float | date | None = None
    high: float | date | None = None


def read_wanted(wanted: object) -> object:
    """``"10 ... 20"``, ``"2021-03-01 ... "`` and the like as :class:`Between`; anything else as it is."""
    match = _RANGE.fullmatch(wanted) if isinstance(wanted, str) else None
    if not match or not any(match.groups()):
        return wanted

    def end(text: str | None) -> float | date | None:
        if text is None:
            return None
        return date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else float(text)

    try:
        return Between(*map(end, match.groups()))
    except ValueError:
        return wanted


def condition(name: str, dtype: str, wanted: object) -> str:
    """What one box asks of a column, as a SQL condition.

    Text looks for itself anywhere in the cell, whatever the case. A list asks for one of its members, None among them
    for an empty cell; None alone for an empty cell; another value for itself. A range compares numbers or dates; in a
    column of text, cells that are none do not fit. Comparisons stand bare beside the column wherever they can, so that Spark
    hands them to the scan: for dates in text, which sort as they follow, the range of the texts is checked first.
    """
    cell, wanted = ref(name), read_wanted(wanted)
    if wanted is None:
        return f"{cell} IS NULL"
    if isinstance(wanted, Between):
        parts = []
        for sign, end in ((">=", wanted.low), ("<=", wanted.high)):
            if end is None:
                continue
            if isinstance(end, date):
                parts += [f"{cell} {sign} '{end.isoformat()}'"] if dtype == "string" else []
                parts.append(f"{'try_cast(' + cell + ' AS DATE)' if dtype == 'string' else cell} {sign} DATE '{end.isoformat()}'")
            else:
                parts.append(f"{cell if dtype in _NUMBERS else f'try_cast({cell} AS DOUBLE)'} {sign} {end!r}D")
        return " AND ".join([f"{cell} IS NOT NULL", *parts])
    if isinstance(wanted, (list, tuple, set, frozenset)):
        named = sorted({str(w) for w in wanted if w is not None})
        among = f"CAST({cell} AS STRING) IN ({', '.join(map(quoted, named))})" if dtype != "string" else one_of(cell, named)
        if dtype in _NUMBERS:
            among = f"{cell} IN ({', '.join(f'{float(w)!r}D' for w in wanted if w is not None)})"
        return any_true([among] * bool(named) + [f"{cell} IS NULL"] * (None in wanted))
    if isinstance(wanted, str) and dtype == "string":
        return f"{cell} IS NOT NULL AND contains(lower({cell}), lower({quoted(wanted)}))"
    return f"{cell} = {f'{float(wanted)!r}D' if dtype in _NUMBERS else quoted(str(wanted))}"


def report_search(report: DataFrame, **wanted: object) -> DataFrame:
    """The rows that fit all boxes, given by column name; see :func:`condition` for what a box may say."""
    types = dict(report.dtypes)
    unknown = sorted(set(wanted) - set(types))
    if unknown:
        raise ValueError(f"no such column(s): {', '.join(unknown)}")
    for name, value in wanted.items():
        report = report.where(condition(name, types[name], value))
    return report


def rules_that_fit(pack: Pack, **wanted: object) -> Pack:
    """The pack with the rules alone whose ``rule_id``, ``description`` and ``short_message`` fit the boxes.

    Rules that a search could not show need not be checked at all.
    """
    fields = {"rule_id", "description", "short_message"}
    if set(wanted) - fields:
        raise ValueError(f"not a text of a rule: {', '.join(sorted(set(wanted) - fields))}")

    def fits(text: str, value: object) -> bool:
        if isinstance(value, (list, tuple, set, frozenset)):
            return text in value
        return isinstance(value, str) and value.lower() in text.lower()

    return pack.only(*[r.rule_id for r in pack.rules if all(fits(getattr(r, f), v) for f, v in wanted.items())])
