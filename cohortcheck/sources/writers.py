"""Write the two result tables of a run, for one site or many, so that nothing of an older run of the day is left."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.plans.report import for_export
from cohortcheck.plans.validation import Result
from cohortcheck.sources import files

TABLES = ("report", "missing")
SITE, DAY = "site", "run_date"


def write_result(
    result: Result,
    path: str,
    run_date: date,
    site: str | None = None,
    fmt: str = "parquet",
    tables: tuple[str, ...] = TABLES,
    sites: Iterable[str] | None = None,
) -> None:
    """Write ``report`` and ``missing`` (or one of them) below ``path``, in folders by site and run date.

    The folders of the checked sites and the day at hand are replaced, by nothing if there is no row now; all others stay.
    Sites count as checked if the run read a row of theirs or ``sites`` names them (such as one whose rows are all gone).
    ``site`` names the one site of a table without a site column.

    Tables are written beside their place first, so a run that fails changes nothing; then folder after folder is
    exchanged. Where readers must not see a state between, use :func:`cohortcheck.sources.publish`.
    """
    spark = result.report.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4()}"
    by = [SITE, DAY] if site is not None or has_sites(result) else [DAY]
    for name in tables:
        write_table(spread(result, name, run_date, site, by), f"{staged}/{name}", by, fmt)
    # Spark spells the folder of a site, whatever characters it has.
    write_table(rebalanced(checked_sites(result, run_date, site, sites), by), f"{staged}/checked", by, "parquet")
    for name in tables:
        for folder in _folders(spark, f"{staged}/checked", len(by)):
            files.remove(spark, f"{path}/{name}/{folder}")
        for folder in _folders(spark, f"{staged}/{name}", len(by)):
            files.remove(spark, f"{path}/{name}/{folder}")
            files.move(spark, f"{staged}/{name}/{folder}", f"{path}/{name}/{folder}")
    files.remove(spark, staged)


def _folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition folders below ``path``, ``depth`` levels deep, relative to it."""
    out = [n for n in files.names_in(spark, path) if "=" in n]
    if depth == 1:
        return out
    return [f"{n}/{inner}" for n in out for inner in _folders(spark, f"{path}/{n}", depth - 1)]


def has_sites(result: Result) -> bool:
    return result.sites is not None and SITE in result.sites.columns


def dated(result: Result, name: str, run_date: date, site: str | None) -> DataFrame:
    """A result table as written out: with its site, if any, and the day of the run. A site without a name is null."""
    table = for_export(result.report) if name == "report" else result.missing
    return _with_site(table, site).withColumn(DAY, F.lit(run_date.isoformat()))


def _with_site(table: DataFrame, site: str | None) -> DataFrame:
    if site is not None:
        return table.withColumn(SITE, F.lit(site))
    return table.withColumn(SITE, F.expr(f"nullif({SITE}, '')")) if SITE in table.columns else table


def checked_sites(result: Result, run_date: date, site: str | None, sites: Iterable[str] | None) -> DataFrame:
    """The sites of a run with its day, one row each, and a mark as the one column that no folder holds.

    Only the site column of the input is read; in a dataset with a folder per site, that is the names of folders.
    """
    spark = result.report.sparkSession
    if site is not None or not has_sites(result):
        found = spark.range(1).select(F.lit(site).alias(SITE))
    else:
        found = _with_site(result.sites.select(SITE), None)
        named = [(s,) for s in sites or ()]
        if named:
            found = found.union(spark.createDataFrame(named, f"{SITE} string"))
        found = found.distinct()
    return found.select(SITE, F.lit(run_date.isoformat()).alias(DAY), F.lit(1).alias("checked"))


def rebalanced(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt out by folder: adaptive execution splits a large site over several tasks and files, and merges small ones."""
    return table.hint("rebalance", *[F.col(c) for c in by])


def spread(result: Result, name: str, run_date: date, site: str | None, by: list[str]) -> DataFrame:
    """:func:`dated`, with rows dealt out by folder. The texts of rules, and the days, are added to a report where its rows
    have come to, not moved with them."""
    if name != "report" or result.describe is None:
        return rebalanced(dated(result, name, run_date, site), by)
    # The day is the same for all.
    moved = rebalanced(_with_site(result.found, site), [c for c in by if c != DAY])
    described = result.describe(moved)
    if site is not None:
        described = described.withColumn(SITE, F.lit(site))
    return for_export(described).withColumn(DAY, F.lit(run_date.isoformat()))


def write_table(table: DataFrame, path: str, by: list[str], fmt: str) -> None:
    """Write ``table``, in folders by ``by``; its rows should be :func:`rebalanced`."""
    table = table.drop(*[c for c in (SITE, DAY) if c not in by])
    writer = table.write.partitionBy(*by)
    writer.option("header", "true").format(fmt).save(path)
