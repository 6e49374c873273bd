"""Read tables of text cells by the names of their columns, and pick sites."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortcheck.functions import quoted, ref

# Files whose headers are looked up at the same time; each lookup is a small job.
LOOKUPS = 16


def read_cells(spark: SparkSession, path: str | Iterable[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """A table with every cell as text, matched by column name; as CSV with a header, Parquet, or another format.

    Files may have columns of their own, in an order, case and (but for CSV, which has none) type of their own: the result has
    all columns, each spelt as in one of the files (for CSV the first that has it), and null where a file lacks it. A file without a row adds
    its columns; a header that names a column twice is an error. Folders such as ``site=01/`` below ``path`` become
    text columns, as written. Options go to the reader.

    Files of one header are one scan, so the plan grows with the number of different headers, not of files. A CSV header is
    the first record of its file, looked up by two small jobs for each file; for the footers of Parquet one job reads all.
    """
    paths = [path] if isinstance(path, str) else list(path)
    scans = [scan for one in paths for scan in _scans(spark, one, fmt, options)]
    if not scans:
        raise ValueError(f"no files: {', '.join(paths)}")
    return union_by_name(scans)


def read_sites(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", site: str = "site", **options: str) -> DataFrame:
    """Several named tables as one, with the name of each as a text column ``site``, in the manner of :func:`read_cells`.

    A filter on the name leaves only the scans of that table in the plan.
    """
    if not paths:
        raise ValueError("no tables to read")
    named = []
    for name, path in paths.items():
        cells = read_cells(spark, path, fmt, **options)
        if site.lower() in {c.lower() for c in cells.columns}:
            raise ValueError(f"{name}: the table has a column {site} of its own")
        named.append(cells.selectExpr(f"{quoted(name)} AS {ref(site)}", "*"))
    return union_by_name(named)


def union_by_name(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows of tables of text, columns matched by name without case; null where a table lacks one."""
    tables = list(tables)
    spelt: dict[str, str] = {}
    for table in tables:
        for name in table.columns:
            spelt.setdefault(name.lower(), name)

    def aligned(table: DataFrame) -> DataFrame:
        own = {c.lower(): c for c in table.columns}
        cell = {k: ref(own[k]) if k in own else "CAST(NULL AS STRING)" for k in spelt}
        return table.selectExpr(*[f"{cell[k]} AS {ref(name)}" for k, name in spelt.items()])

    out = aligned(tables[0])
    for table in tables[1:]:
        out = out.union(aligned(table))
    return out


def _scans(spark: SparkSession, path: str, fmt: str, options: dict[str, str]) -> list[DataFrame]:
    """One scan per set of columns among the files below ``path``."""
    # Any file reads as lines, so this only lists them and names the folders' columns.
    listed = spark.read.format("text").load(path)
    folders = listed.columns[1:]
    base = {"basePath": path} if folders else {}
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "false", **options}
        groups = _by_schema(spark, listed, fmt, options)
    else:
        options = {"mergeSchema": "true", **options}
        try:
            merged = spark.read.format(fmt).options(**options).load(path).schema
            groups = {_without(merged, folders): [path]}
        except (Py4JJavaError, PySparkException) as clash:
            if "CANNOT_MERGE" not in str(clash):
                raise
            # Two files disagree on the type of a column.
            groups = _by_schema(spark, listed, fmt, options)
    out = []
    for schema, files in groups.items():
        twice = sorted({f.name for f in schema if [g.name.lower() for g in schema].count(f.name.lower()) > 1})
        if twice:
            raise ValueError(f"{files[0]}: column(s) named twice: {', '.join(twice)}")
        typed = StructType([*schema, *[StructField(c, StringType()) for c in folders]])
        scan = spark.read.schema(typed).format(fmt).options(**options, **base).load(files)
        out.append(scan.selectExpr(*[f"CAST({ref(c)} AS STRING) AS {ref(c)}" for c in scan.columns]))
    return out


def _without(schema: StructType, names: list[str]) -> StructType:
    return StructType([f for f in schema if f.name not in names])


def _by_schema(
    spark: SparkSession, listed: DataFrame, fmt: str, options: dict[str, str]
) -> dict[StructType, list[str]]:
    """The files of a listing, grouped by the columns that each says it has, in order of their paths."""

    def schema(file: str) -> StructType:
        if fmt != "csv":
            return spark.read.format(fmt).options(**options).load(file).schema
        # As plain records, since the reader would give new names to columns of one name.
        first = spark.read.options(**{**options, "header": "false"}).csv(file).first() or ()
        return StructType([StructField(name or f"_c{i}", StringType()) for i, name in enumerate(first)])

    files = sorted(unquote(f) for f in listed.inputFiles())
    with ThreadPoolExecutor(LOOKUPS) as lookups:
        found = list(lookups.map(schema, files))
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for file, columns in zip(files, found):
        if not columns.fields:
            continue  # an empty file
        groups.setdefault(columns.json(), (columns, []))[1].append(file)
    return {columns: members for columns, members in groups.values()}


def stage(df: DataFrame, path: str, row: str = "row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Write the table as Parquet and read it back, numbering its rows if they have no id yet.

    The validation plan reads its input more than once. Staging makes that cheap for row formats
    such as CSV, and fixes the row ids, which are only reproducible once written.
    """
    if row not in df.columns:
        df = df.withColumn(row, F.monotonically_increasing_id())
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    # Folders are read as the text that they were written from, so ``01`` stays ``01``.
    kept = StructType([StructField(f.name, StringType() if f.name in by else f.dataType) for f in df.schema])
    return df.sparkSession.read.schema(kept).parquet(path).select(*[F.col(ref(c)) for c in df.columns])


def list_sites(df: DataFrame, site: str = "site") -> DataFrame:
    """The sites of a dataset, in order."""
    return df.select(site).distinct().orderBy(site)


def choose_site(df: DataFrame, value: str, site: str = "site") -> DataFrame:
    """The rows of one site; on a partitioned dataset only its folder is read."""
    return df.where(F.col(site) == value)
