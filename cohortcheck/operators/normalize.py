"""Turn an all-text table into a typed one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cohortcheck.functions import Selector, any_of, contains, mixed_date, number, ref
from cohortcheck.functions.parsing import NULL_TOKENS, key_number, known, trimmed


@dataclass(frozen=True)
class Layout:
    """Which columns identify a row, and which hold dates and numbers.

    ``subject`` holds the subject key. ``row`` is an integer that orders the rows of one subject
    and differs between them. ``by`` lists columns that keep subjects apart, such as a site.
    """

    subject: str = "subject_id"
    row: str = "row_id"
    by: tuple[str, ...] = ()
    dates: Selector = field(default_factory=lambda: contains("date"))
    numbers: Selector = field(
        default_factory=lambda: (contains("cd4") & ~contains("date")) | contains("bmi") | any_of("age")
    )
    optional: tuple[str, ...] = ("gender_id", "immigration_status_undoc")
    null_tokens: tuple[str, ...] = NULL_TOKENS

    @property
    def keys(self) -> list[str]:
        """The columns that identify a subject."""
        return [*self.by, self.subject]

    @property
    def raw_key(self) -> str:
        """Where the normalised table keeps the key as it was written."""
        return f"{self.subject}_text"

    @property
    def reserved(self) -> set[str]:
        return {*self.keys, self.row, self.raw_key}

    def cells(self, columns: list[str]) -> list[str]:
        """The columns that hold data, in table order."""
        return [c for c in columns if c not in self.reserved]


def clean_cells(df: DataFrame, layout: Layout) -> DataFrame:
    """Every cell trimmed, blanks and null tokens to null; the key moves to ``raw_key``."""
    return _cleaned(df, layout)


def _cleaned(df: DataFrame, layout: Layout, *more: str) -> DataFrame:
    """:func:`clean_cells`, and ``more`` columns made of the cells as they were written."""
    types = dict(df.dtypes)
    for name in (layout.subject, layout.row, *layout.by):
        if name not in types:
            raise ValueError(f"missing required column(s): {name}")

    twice = sorted({c for c in df.columns if [n.lower() for n in df.columns].count(c.lower()) > 1})
    if twice:
        raise ValueError(f"columns that differ only by case: {', '.join(twice)}")

    def short(name: str) -> str:
        return trimmed(ref(name) if types[name] == "string" else f"CAST({ref(name)} AS STRING)")

    # Two projections, so that each cell is trimmed once and then compared.
    cells = layout.cells(df.columns)
    short_cells = df.selectExpr(
        *[f"coalesce(CAST({ref(c)} AS STRING), '') AS {ref(c)}" for c in layout.by],
        f"{short(layout.subject)} AS {ref(layout.raw_key)}",
        f"CAST({ref(layout.row)} AS BIGINT) AS {ref(layout.row)}",
        *[f"{short(c)} AS {ref(c)}" for c in cells],
        *more,
    )
    kept = [*layout.by, layout.row, *short_cells.columns[len(short_cells.columns) - len(more) :]]
    return short_cells.selectExpr(
        *[ref(c) if c in kept else f"{known(ref(c), layout.null_tokens)} AS {ref(c)}" for c in short_cells.columns]
    )


def normalize(df: DataFrame, layout: Layout | None = None, drop_keyless: bool = True) -> DataFrame:
    """Null tokens to null, mixed dates to dates, numbers to doubles, absent optional columns added.

    Projections and no shuffle. Rows whose key is not a number are dropped, or kept with a null
    key when ``drop_keyless`` is false. A null ``by`` value becomes empty text, so that it still
    groups and joins.
    """
    layout = layout or Layout()
    cells = layout.cells(df.columns)
    dates = set(layout.dates(cells))
    numbers = set(layout.numbers(cells)) - dates

    def typed(name: str) -> str:
        cell = ref(name)
        return f"{mixed_date(cell) if name in dates else number(cell) if name in numbers else cell} AS {cell}"

    # Conditions on the key are tested on the table itself, where what makes the key is named again and again.
    written = ref(layout.subject) if dict(df.dtypes).get(layout.subject) == "string" else f"CAST({ref(layout.subject)} AS STRING)"
    out = _cleaned(df, layout, f"{key_number(written, layout.null_tokens)} AS {ref(layout.subject)}").selectExpr(
        *map(ref, layout.by),
        ref(layout.subject),
        ref(layout.raw_key),
        ref(layout.row),
        *[typed(c) for c in cells],
        *[f"CAST(NULL AS STRING) AS {ref(c)}" for c in layout.optional if c.lower() not in {n.lower() for n in cells}],
    )
    return out.where(f"{ref(layout.subject)} IS NOT NULL") if drop_keyless else out
