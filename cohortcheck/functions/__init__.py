"""Column selectors, and SQL expressions shared by the operators.

Expressions are built as SQL text. One text per output column crosses into the JVM once, while a
``Column`` built up piece by piece crosses it for every piece; over hundreds of columns and rules
that made planning take longer than running.
"""

from cohortcheck.functions.parsing import clean_text, mixed_date, number, number_text, text_of
from cohortcheck.functions.selectors import Selector, any_of, column, contains, everything
from cohortcheck.functions.sql import any_true, array, holds, one_of, quoted, ref

__all__ = [
    "Selector",
    "any_of",
    "any_true",
    "array",
    "clean_text",
    "column",
    "contains",
    "everything",
    "holds",
    "mixed_date",
    "number",
    "number_text",
    "one_of",
    "quoted",
    "ref",
    "text_of",
]
