"""A report written in order, of which any page is read at the cost of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortcheck.functions import ref

_AT, _RANGE = "_at", "_range"
# Spark's row ids count within a partition in their lower bits.
_BITS = 33


def write_ordered(report: DataFrame, path: str, order: list[str]) -> None:
    """Write ``report`` sorted by ``order`` (rising, nulls first), in a folder per range, with a list of the ranges.

    Spark samples the ends of the ranges, and each is sorted by a task of its own. Add columns to ``order`` until few rows
    are alike in all of them; those that are keep the order that they are written in.
    """
    sorted_rows = report.repartitionByRange(*[F.col(ref(c)) for c in order]).sortWithinPartitions(*[F.col(ref(c)) for c in order])
    numbered = sorted_rows.withColumn(_AT, F.monotonically_increasing_id()).withColumn(_RANGE, F.spark_partition_id())
    numbered.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    written = report.sparkSession.read.schema(f"{_AT} bigint, {_RANGE} int").parquet(f"{path}/rows")
    written.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/ranges")
    # The columns of a report without a row are known too.
    report.limit(0).coalesce(1).write.parquet(f"{path}/columns")


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of a report that :func:`write_ordered` wrote, in its order; empty beyond the last one.

    The list of ranges, one row for each task that sorted, tells where the page lies; only these folders are listed, and in
    them the row ids let Parquet skip all but the row groups of the page. So page 10,000 takes what page 1 takes.
    """
    if number < 1 or size < 0:
        raise ValueError("pages count from 1, and hold no less than no row")
    first, end = (number - 1) * size, number * size
    columns = spark.read.parquet(f"{path}/columns").schema
    wanted, before = [], 0
    for r in sorted(spark.read.parquet(f"{path}/ranges").collect()):
        low, high = max(first - before, 0), min(end - before, r["n"])
        if low < high:
            start = r[_RANGE] << _BITS
            wanted.append(f"({_RANGE} = {r[_RANGE]} AND {_AT} >= {start + low} AND {_AT} < {start + high})")
        before += r["n"]
    if not wanted:
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(StructType([*columns, StructField(_AT, LongType()), StructField(_RANGE, IntegerType())])).parquet(f"{path}/rows")
    page = rows.where(" OR ".join(wanted)).orderBy(_AT)
    return page.drop(_AT, _RANGE)
