"""The rows before a row, for subjects that own several rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcheck.functions import ref
from cohortcheck.operators.keys import N_ROWS

PREVIOUS = "_previous"
# Rows of one subject that one task sorts at a time, and the most ranges that one shuffle makes.
CHUNK_ROWS = 500_000
MAX_RANGES = 20_000

_CHUNK, _END = "_chunk", "_end"


def in_ranges(rows: DataFrame, keys: list[str], row: str, n_rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``_chunk``: rows of large subjects lie in numbered ranges of about ``chunk_rows`` rows, in order.

    Spark draws the range ends from a sample of the rows themselves, so ranges are even however the ids cluster. The
    checkpoint fixes them: a task that runs again finds the same ranges.
    """
    ranges = min(MAX_RANGES, max(1, -(-n_rows // chunk_rows)))
    large = rows.where(f"{N_ROWS} > {chunk_rows}").repartitionByRange(ranges, *keys, row)
    large = large.withColumn(_CHUNK, F.spark_partition_id()).checkpoint()
    return rows.where(f"{N_ROWS} <= {chunk_rows}").withColumn(_CHUNK, F.lit(0)).unionByName(large)


def with_neighbour_rows(
    rows: DataFrame,
    keys: list[str],
    row: str,
    columns: list[str],
    n_rows: int,
    largest: int,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``_previous``: the ``columns`` of the subject's preceding row, as a struct.

    ``rows`` carry the row count of their subject; ``n_rows`` is their number, ``largest`` that of the largest subject. A subject
    with more than ``chunk_rows`` rows is cut into ranges, each sorted by a task of its own; the last row of each
    range is then handed to the first row of the next. Fails if two rows of a subject have the same id.
    """
    split = largest > chunk_rows
    parted = in_ranges(rows, keys, row, n_rows, chunk_rows) if split else rows.withColumn(_CHUNK, F.lit(0))
    carried = F.struct(*columns)
    in_chunk = Window.partitionBy(*keys, _CHUNK).orderBy(row)
    message = F.raise_error(F.lit(f"{row}: rows of a subject need ids that differ"))
    same = F.lag(row).over(in_chunk) == F.expr(ref(row))
    out = parted.withColumn(PREVIOUS, F.when(same, message).otherwise(F.lag(carried).over(in_chunk)))
    if split:
        ends = (
            parted.where(f"{N_ROWS} > {chunk_rows}")
            .groupBy(*keys, _CHUNK)
            .agg(F.max(row).alias(row))
        )
        # The last row of a range is the one with that id; it needs no sort.
        last = parted.where(f"{N_ROWS} > {chunk_rows}").select(*keys, _CHUNK, row, carried.alias(_END))
        ends = ends.join(last, [*keys, _CHUNK, row])
        # One record per range, so the window below holds a subject's ranges, not its rows.
        in_subject = Window.partitionBy(*keys).orderBy(_CHUNK)
        ends = ends.select(*keys, _CHUNK, F.lag(_END).over(in_subject).alias(_END))
        out = (
            out.join(ends, [*keys, _CHUNK], "left")
            .withColumn(PREVIOUS, F.coalesce(PREVIOUS, _END))
            .drop(_END)
        )
    return out.drop(_CHUNK)
