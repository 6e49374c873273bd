"""What the operators of this folder share: checkpoints, checked lookups, hashing of words."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII white space; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

# A side is broadcast only while its measured size stays below these.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package, wherever the driver was started.

    On a cluster the package is installed or sent with the job (``--py-files``).
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A local session without ``spark.checkpoint.dir`` (tests) gets a folder of its own; elsewhere it must be set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder that ``spark.checkpoint.dir`` names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame) -> bool:
    """Is ``df`` (already materialised) below both bounds for a broadcast?"""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(16) for c in df.columns),
        F.lit(0),
    )
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_checked(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of facts to ``big``: broadcast after its size was measured, else shuffled.

    ``small`` must be materialised, since it is read twice. In the shuffled form adaptive execution splits the
    partitions of hot keys, which stand on the side of ``big`` only.
    """
    return big.join(F.broadcast(small) if small_enough(small) else small, list(on), how)


def let(df: DataFrame, keep: Iterable[Column | str], **values: Column) -> DataFrame:
    """Compute ``values`` once, as columns that later expressions cannot be merged with.

    Catalyst repeats an expression wherever a lambda uses it; a generator of one row stops that.
    """
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    kept = list(keep)
    exploded = df.select(*kept, F.explode(F.array(packed)).alias("_let"))
    names = exploded.columns[:-1]
    return exploded.select(*[F.col(f"`{n}`") for n in names], *[F.col("_let")[k].alias(k) for k in values])


def words_of(text: Column) -> Column:
    """All words of a whole text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


# ---- hashing of words and shingles, a few MB of text at a time -------------------------------------

CHUNK_BYTES = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "base" not in _powers or len(_powers["base"]) < n:
        size = max(n, CHUNK_BYTES * 2)
        step = 0x5851F42D4C957F2D
        up = np.full(size, step, np.uint64)
        down = np.full(size, pow(step, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["base"] = np.multiply.accumulate(up)
        _powers["back"] = np.multiply.accumulate(down)
        _powers["byte"] = mix64(np.arange(1, 257, dtype=np.uint64))
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _powers["space"] = space
    return _powers["base"], _powers["back"], _powers["byte"]


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and 64-bit hash of each word, in order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    base, back, byte = _tables(len(data))
    blank = _powers["space"][data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[data] * base[: len(data)], dtype=np.uint64)))
    hashes = mix64((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return np.searchsorted(ends, starts, side="right"), hashes


def shingle_hashes(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each window of ``width`` words; a shorter text is one window."""
    owner, words = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    turn = mix64(np.arange(width, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    n = len(words) - width + 1
    if n > 0:
        window = np.zeros(n, np.uint64)
        for k in range(width):
            window += words[k : k + n] * turn[k]
        inside = owner[:n] == owner[width - 1 :]
        ids, hashes = owner[:n][inside], mix64(window[inside])
    else:
        ids, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.searchsorted(owner, short)
        alone = np.array(
            [(words[a : a + counts[d]] * turn[: counts[d]]).sum(dtype=np.uint64) for a, d in zip(at, short)], np.uint64
        )
        ids = np.concatenate((ids, short))
        hashes = np.concatenate((hashes, mix64(alone ^ counts[short].astype(np.uint64))))
    return ids, hashes


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold a few MB of text each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


# ---- positions in an order, and folders of one run ---------------------------------------------------


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its gapless ``position`` (from 0) in this order, checkpointed.

    Rows are dealt to ranges whose ends Spark samples, each range is sorted by a task of its own, and the sizes of the
    ranges before are added. ``order`` should tell all rows apart, so that no value fills a range by itself.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as there are shuffle partitions, whatever the number of rows.
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], position.alias("position"))


def text_digest(text: Column) -> Column:
    """32 bytes that stand for a whole text; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
