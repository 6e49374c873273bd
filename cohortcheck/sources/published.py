"""Results of many runs, of which readers see the last one per site and day, both tables at once.

Below a folder, each run writes its tables into places of its own (``report/run=…/site=…/run_date=…``), then the list of
what is valid from now on (``entries/<run>``), and last a numbered file that makes the run count (``commits/``). Readers start
from the highest number, so they find a run whole or not at all. Nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cohortcheck.plans.validation import Result
from cohortcheck.sources import files
from cohortcheck.sources.writers import DAY, SITE, TABLES, checked_sites, has_sites, spread, write_table

RUN = "run"
_KEYS = [SITE, DAY]


def publish(
    result: Result,
    path: str,
    run_date: date,
    site: str | None = None,
    fmt: str = "parquet",
    sites: Iterable[str] | None = None,
) -> str:
    """Make a run the valid one for its sites and day, and return its id.

    For each checked site, both tables of that day now hold what this run found, which may be no row; other sites and days
    are as before. Sites count as checked if the run read a row of theirs or ``sites`` names them; ``site`` names the one site
    of a table without a site column. If another run was published meanwhile this one fails and leaves no trace in
    what readers see; publish it again.
    """
    spark = result.report.sparkSession
    if site is None and not has_sites(result):
        raise ValueError("a table without a site column needs the name of its site")
    before, number = _latest(spark, path)
    run = uuid.uuid4().hex
    schemas = {}
    for name in TABLES:
        table = spread(result, name, run_date, site, _KEYS)
        schemas[name] = table.drop(*_KEYS).schema.json()
        write_table(table, f"{path}/{name}/{RUN}={run}", _KEYS, fmt)
    entries = checked_sites(result, run_date, site, sites).select(*_KEYS, F.lit(run).alias(RUN))
    if before:
        old = spark.read.parquet(f"{path}/entries/{before[RUN]}").alias("o")
        here = entries.alias("n")
        same = F.expr(" AND ".join(f"o.{k} <=> n.{k}" for k in _KEYS))
        entries = old.join(here, same, "left_anti").unionByName(entries)
    # One row per site and day ever published: a few files hold it.
    entries.coalesce(8).write.parquet(f"{path}/entries/{run}")
    commit = json.dumps({RUN: run, "format": fmt, "schemas": schemas})
    files.write_new(spark, f"{path}/commits/{number + 1:010d}", commit)
    return run


def _latest(spark: SparkSession, path: str) -> tuple[dict | None, int]:
    numbers = files.names_in(spark, f"{path}/commits")
    numbers = [n for n in numbers if n.isdigit()]
    if not numbers:
        return None, 0
    text = spark.read.option("wholetext", "true").text(f"{path}/commits/{numbers[-1]}").first()[0]
    return json.loads(text), int(numbers[-1])


def published_runs(spark: SparkSession, path: str) -> DataFrame:
    """``site, run_date, run``: which run is valid for each site and day."""
    commit, _ = _latest(spark, path)
    if commit is None:
        return spark.createDataFrame([], f"{SITE} string, {DAY} string, {RUN} string")
    return spark.read.parquet(f"{path}/entries/{commit[RUN]}").select(*_KEYS, RUN)


def read_published(spark: SparkSession, path: str, table: str, run_date: date | None = None) -> DataFrame:
    """The valid rows of ``report`` or ``missing`` with ``site`` and ``run_date``, of one day or all.

    Folders of runs that count no more are not listed for reading; filters on site and day prune the others.
    """
    commit, _ = _latest(spark, path)
    if commit is None:
        raise ValueError(f"nothing was published in {path}")
    valid = published_runs(spark, path)
    if run_date is not None:
        valid = valid.where(F.col(DAY) == run_date.isoformat())
    # One value per run that counts for some site and day.
    runs = [r[RUN] for r in valid.select(RUN).distinct().collect()]
    schema = _schema(commit, table)
    reader = spark.read.schema(schema).format(commit["format"]).option("header", "true")
    rows = reader.load(f"{path}/{table}").where(F.col(RUN).isin(runs)).alias("t")
    same = F.expr(" AND ".join(f"t.{k} <=> v.{k}" for k in (*_KEYS, RUN)))
    return rows.join(valid.alias("v"), same, "left_semi").drop(RUN)


def _schema(commit: dict, table: str) -> StructType:
    schema = StructType.fromJson(json.loads(commit["schemas"][table]))
    for name in (RUN, *_KEYS):
        schema = schema.add(name, StringType())
    return schema


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of runs that count for no site and day any more, and return their ids.

    Not for use while a run is being published: its folders count only once it is.
    """
    kept = {r[RUN] for r in published_runs(spark, path).select(RUN).distinct().collect()}
    commit, _ = _latest(spark, path)
    kept_entries = {commit[RUN]} if commit else set()
    gone = set()
    for table in TABLES:
        for name in files.names_in(spark, f"{path}/{table}"):
            run = name.removeprefix(f"{RUN}=")
            if run != name and run not in kept:
                files.remove(spark, f"{path}/{table}/{name}")
                gone.add(run)
    for run in files.names_in(spark, f"{path}/entries"):
        if run not in kept_entries:
            files.remove(spark, f"{path}/entries/{run}")
    return sorted(gone)
