"""Folders on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``, in order; none if there is no such folder."""
    files, target = _at(spark, path)
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, target = _at(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another place, on the same file system, where nothing stands."""
    files, old = _at(spark, source)
    _, new = _at(spark, target)
    files.mkdirs(new.getParent())
    if files.exists(new) or not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet; of two writers of one path, one fails."""
    files, target = _at(spark, path)
    files.mkdirs(target.getParent())
    out = files.create(target, False)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
