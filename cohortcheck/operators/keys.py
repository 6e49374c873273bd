"""Subjects that own more than one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcheck.functions import ref

N_ROWS, FIRST_ROW, LAST_ROW = "_n_rows", "_first_row", "_last_row"


def repeated_keys(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The keys found on several rows, with the row count and the first and last row id.

    Reads the key and row id columns only. Counts are combined before the shuffle, so a key that
    holds a large share of the table sends one record per task. Fails if rows of a subject have no id, or
    all have the same one: ids tell them apart and order them.
    """
    unordered = f"count(1) > 1 AND (count({ref(row)}) < count(1) OR min({ref(row)}) = max({ref(row)}))"
    message = f"raise_error('{row}: rows of a subject need ids that differ')"
    return (
        df.where(f"{ref(keys[-1])} IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.expr(f"count(1) AS {N_ROWS}"),
            F.expr(f"CASE WHEN {unordered} THEN {message} ELSE min({ref(row)}) END AS {FIRST_ROW}"),
            F.expr(f"max({ref(row)}) AS {LAST_ROW}"),
        )
        .where(f"{N_ROWS} > 1")
    )
