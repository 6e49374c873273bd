"""The report table, and the views on it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcheck.functions import ref
from cohortcheck.operators.normalize import Layout
from cohortcheck.plans.rules import Rule


def assemble(found: DataFrame, rules: Iterable[Rule], layout: Layout) -> DataFrame:
    """Add the texts of each rule, and the days between two dates, to a table of violations.

    The texts come from a broadcast table of one row per rule.
    """
    texts = found.sparkSession.createDataFrame(
        [(r.rule_id, r.description, r.short_message) for r in rules],
        "rule_id string, description string, short_message string",
    )
    return found.join(F.broadcast(texts), "rule_id").selectExpr(
        *map(ref, layout.keys),
        "rule_id",
        "description",
        "column1",
        "value1",
        "column2",
        "value2",
        "short_message",
        f"{days_between('column1', 'value1', 'column2', 'value2')} AS date_difference",
    )


def days_between(column1: str, value1: str, column2: str, value2: str) -> str:
    """Days from the first to the second value as text, if both columns are named as dates."""
    dated = f"contains(lower({column1}), 'date') AND contains(lower({column2}), 'date')"
    days = f"datediff(try_cast({value2} AS DATE), try_cast({value1} AS DATE))"
    return f"CASE WHEN {dated} THEN CAST({days} AS STRING) END"


def summarize(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of violations per message, most frequent first."""
    return (
        report.groupBy(*by, "short_message")
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy(F.desc("error_count"), *by, "short_message")
    )


def report_filter(report: DataFrame, **equals: object) -> DataFrame:
    """The report rows whose columns equal the given values; None asks for null."""
    for name, value in equals.items():
        report = report.where(F.col(name).eqNullSafe(F.lit(value)))
    return report


def report_page(report: DataFrame, order: list[str | Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page of the report in the given order. Add columns to ``order`` until it is total."""
    return report.orderBy(*order).offset((number - 1) * size).limit(size)


def for_export(report: DataFrame) -> DataFrame:
    """The report as written out: without the short message."""
    return report.drop("short_message")
