"""SQL expressions that turn text cells into typed values.

All of them give null for text they cannot read and never raise, also in ANSI mode. Common
spellings take a cheap branch; only the others reach a regular expression.
"""

from __future__ import annotations

from cohortcheck.functions.sql import one_of, quoted

# Cells that mean "unknown", compared with case.
NULL_TOKENS = ("NA", "UNK", "Unk", "N/A", "88888", "888888", "99999", "999999")

# Fixed value: day zero of spreadsheet date serials.
SERIAL_ORIGIN = "1899-12-30"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A prefix is enough: what follows the day (such as a time) is ignored.
_MONTH_DAY_YEAR = r"(?s)^(?:(\d{1,2})/(\d{1,2})/(\d{1,4}).*|.*)$"
_YEAR_MONTH_DAY = r"(?s)^(?:(\d{1,4})-(\d{1,2})-(\d{1,2}).*|.*)$"


# White space of ASCII and of Unicode, as the escapes of a SQL literal, and as a class in a regular expression.
_ASCII_BLANKS = " \\t\\n\\u000B\\u000C\\r"
_BLANKS = _ASCII_BLANKS + "\\u0085\\u00A0\\u1680" + "".join(f"\\u200{c}" for c in "0123456789A")
_BLANKS += "\\u2028\\u2029\\u202F\\u205F\\u3000"
BLANK_CLASS = r"[\s\x85\p{Z}]"


def trimmed(cell: str) -> str:
    """The cell without white space at its ends. Only cells with a character beyond ASCII are held against all of Unicode's."""
    blanks = f"if(octet_length({cell}) = char_length({cell}), '{_ASCII_BLANKS}', '{_BLANKS}')"
    return f"trim(BOTH {blanks} FROM {cell})"


def known(cell: str, tokens: tuple[str, ...] = NULL_TOKENS) -> str:
    """A trimmed cell; null when it is blank or one of ``tokens``."""
    return f"CASE WHEN NOT {one_of(cell, ('', *tokens))} THEN {cell} END"


def clean_text(cell: str, tokens: tuple[str, ...] = NULL_TOKENS) -> str:
    """The trimmed cell; null when it is blank or one of ``tokens``."""
    return known(trimmed(cell), tokens)


def number(cell: str) -> str:
    """A decimal or exponent number as double, else null (also for ``NaN`` and ``1d``)."""
    return f"CASE WHEN {cell} RLIKE {quoted(_NUMBER)} THEN try_cast({cell} AS DOUBLE) END"


def key_number(cell: str, tokens: tuple[str, ...] = NULL_TOKENS) -> str:
    """The number in a cell as it was written: what :func:`number` makes of its :func:`clean_text`.

    Whole numbers in their shortest spelling, as most keys are, are read at once, without a pattern. ``cell`` should be a
    column, since it is named often.
    """
    whole = f"try_cast({cell} AS BIGINT)"
    return (
        f"CASE WHEN CAST({whole} AS STRING) = {cell} AND NOT {one_of(cell, ('', *tokens))} THEN CAST({whole} AS DOUBLE) "
        f"ELSE {number(clean_text(cell, tokens))} END"
    )


def mixed_date(cell: str) -> str:
    """A date written month/day/year, year-month-day, or as a spreadsheet serial.

    The separator decides: ``/`` first, then ``-``, else a serial, of which the fraction of the
    day is dropped. The year may have one to four digits and is taken as written (``21`` is the
    year 21). Zeros put before the year keep it within the widths that the date cast accepts.
    """
    return (
        f"CASE WHEN contains({cell}, '/') THEN "
        f"try_cast(regexp_replace({cell}, {quoted(_MONTH_DAY_YEAR)}, '000$3-$1-$2') AS DATE) "
        f"WHEN contains({cell}, '-') THEN "
        f"coalesce(CASE WHEN length({cell}) = 10 AND substring({cell}, 5, 1) = '-' THEN try_cast({cell} AS DATE) END, "
        f"try_cast(regexp_replace({cell}, {quoted(_YEAR_MONTH_DAY)}, '000$1-$2-$3') AS DATE)) "
        f"ELSE date_add(DATE '{SERIAL_ORIGIN}', "
        f"coalesce(try_cast({cell} AS INT), try_cast(floor({number(cell)}) AS INT))) END"
    )


def number_text(value: str) -> str:
    """A double as text, whole numbers without ``.0``."""
    return (
        f"CASE WHEN {value} = rint({value}) THEN coalesce(CAST(try_cast({value} AS DECIMAL(38, 0)) AS STRING), "
        f"CAST({value} AS STRING)) ELSE CAST({value} AS STRING) END"
    )


def text_of(value: str, dtype: str) -> str:
    """A cell of a type as report text."""
    if dtype == "string":
        return value
    return number_text(value) if dtype in ("double", "float") else f"CAST({value} AS STRING)"
