"""Missing-value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcheck.functions import ref


def missing_profile(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``column, n_missing, total_count`` for each of ``columns``, per value of ``by``.

    Counted in one pass with partial aggregation; only the single row of counts (one per ``by``
    value) is turned to long form.
    """
    counts = df.groupBy(*[F.col(ref(c)) for c in by]).agg(
        *[F.expr(f"count(1) - count({ref(c)}) AS {ref(c)}") for c in columns],
        F.expr("count(1) AS total_count"),
    )
    kept, values = [F.col(ref(c)) for c in (*by, "total_count")], [F.col(ref(c)) for c in columns]
    long = counts.unpivot(kept, values, "column", "n_missing")
    return long.select(*kept[:-1], "column", "n_missing", "total_count")
