"""Shards of nearly equal size: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed, join_checked, numbered, read_table, text_digest

SHARDS = 8

# Runs of equal sizes up to this length go through the heap one by one; of longer runs, the shares are computed.
SHORT_RUN = 64


def _shares(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets when each goes to the least loaded, ties to the first.

    A shard takes its groups at the loads ``load, load + size, …``; the ``count`` smallest of these are taken. Bisection
    finds the largest bound below which no more than ``count`` lie; what is left goes to those next in line.
    """

    def below(bound: int) -> list[int]:
        return [max(0, -((load - bound) // size)) for load in loads]

    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        middle = (low + high) // 2
        if sum(below(middle)) <= count:
            low = middle
        else:
            high = middle
    out = below(low)
    ready = sorted((load + n * size, j) for j, (load, n) in enumerate(zip(loads, out)))
    for _, j in ready[: count - sum(out)]:
        out[j] += 1
    return out


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """Longest processing time first: ``counts[i]`` groups of ``sizes[i]`` (falling) each go to the least loaded shard.

    Returns for each size where the shares of the shards end among its groups, and the final loads. Groups of one
    size are alike, so they are dealt out in blocks: the first to shard 0, the next to shard 1, and so on.
    """
    ends = np.zeros((len(sizes), shards), np.int64)
    heap = [(0, j) for j in range(shards)]
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if count <= SHORT_RUN:
            for _ in range(count):
                load, j = heap[0]
                ends[i, j] += 1
                heapq.heapreplace(heap, (load + size, j))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda pair: pair[1])]
            ends[i] = _shares(loads, size, count)
            heap = [(load + size * int(n), j) for j, (load, n) in enumerate(zip(loads, ends[i]))]
            heapq.heapify(heap)
    return ends.cumsum(axis=1), [load for load, _ in sorted(heap, key=lambda pair: pair[1])]


def place_groups(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``group, shard`` for each group of ``rows(group, size, doc_id)``; sizes are positive.

    Groups are sorted by size in ranges, each by a task of its own; ties go to the group with the smaller first id, one
    without ids last. Only the number of groups of each size passes through the driver, where the heap is: sizes that
    differ add up, so all bytes hold at most the root of twice their number of them (14 million in 100 TB, if
    every length occurs; texts of up to 1 MB have a million).
    """
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"))
    ordered = numbered(groups, F.desc("bytes"), F.asc_nulls_last("first_id"), F.asc("group"))
    found = ordered.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).toArrow()
    sizes, counts = (found.column(c).to_numpy() for c in ("bytes", "n"))
    ends, _ = schedule(sizes, counts, shards)
    # Positions count over all sizes, so the ends of a size start from the groups before it.
    ends += (counts.cumsum() - counts)[:, None]
    lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * shards, ends.ravel())
    plan = rows.sparkSession.createDataFrame(pa.table({"bytes": pa.array(sizes, pa.int64()), "ends": lists}))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("position"))).cast("int")
    return join_checked(ordered, plan, ["bytes"], "inner").select("group", shard.alias("shard"))


def assign(docs: DataFrame, shards: int = SHARDS, together: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, text_digest`` for every row of ``docs(doc_id, text)``.

    ``size`` is the UTF-8 bytes of the text and one more; rows with an equal ``together`` (by default: an equal whole text, by
    SHA-256) get the same shard, and shards get nearly equal sizes (``law`` is ``bytes``) as far as the largest group lets them.
    ``slot`` numbers the rows of a shard from 0 by id, without gaps, ids that are null last. ``grown_shard`` is null: another
    number of shards moves rows between all. A null text counts as an empty one; repeated rows get a slot each; an empty
    table gives an empty result; further columns are ignored.

    Texts are read once and stay where they are. What moves are rows of ids, sizes and digests: combined by group before
    the shuffle, so that a text with a third of all rows is one record per task; joined back to the rows, where adaptive
    execution splits such a group; and sorted in ranges for the slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = text_digest(F.col("text"))
    digest = F.unhex(F.sha2(F.to_json(F.struct(together.alias("k"))), 256)) if together is not None else key
    rows = checkpointed(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            digest.alias("group"),
            key.alias("text_digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    placed = rows.join(place_groups(rows, shards), "group")
    ordered = numbered(placed.drop("group"), F.asc("shard"), F.asc_nulls_last("doc_id"), F.asc("row"))
    # One row per shard.
    starts = checkpointed(ordered.groupBy("shard").agg(F.min("position").alias("start")))
    return ordered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_digest",
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` with all their columns as Parquet, in a folder ``shard=…`` per shard, equal texts together.

    A column named ``shard`` or ``_digest`` would clash and is refused. Shards are found per text, which is few bytes for each;
    the texts themselves move only if these are too many to be sent around.
    """
    clash = {c.lower() for c in docs.columns} & {"shard", "_digest"}
    if clash:
        raise ValueError(f"columns that this output uses itself: {', '.join(sorted(clash))}")
    found = assign(docs, shards).groupBy(F.col("text_digest").alias("_digest")).agg(F.first("shard").alias("shard"))
    out = join_checked(docs.withColumn("_digest", text_digest(F.col("text"))), checkpointed(found), ["_digest"], "inner")
    out.drop("_digest").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents")).drop("text_digest")


# DuckDB: the heap as a list of loads that a recursion carries from group to group.
SQL = {
    "op12_sharding": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents
), g AS (
  SELECT t, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, min(doc_id), sha256(t)) AS i FROM d GROUP BY t
), lpt(i, bytes, shard, loads) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0, [0::BIGINT FOR x IN range({SHARDS})]
  UNION ALL
  SELECT g.i, g.bytes, list_position(loads, list_min(loads)) - 1,
         [load + CASE WHEN k = list_position(loads, list_min(loads)) THEN g.bytes ELSE 0 END FOR load, k IN loads]
  FROM lpt JOIN g ON g.i = lpt.i + 1
), s AS (
  SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS k FROM lpt WHERE i > 0
), p AS (
  SELECT t, shard FROM (SELECT t, bytes, row_number() OVER (PARTITION BY bytes ORDER BY i) AS k FROM g) JOIN s USING (bytes, k)
), bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS a FROM bits WHERE k = 8
), h AS (
  SELECT t, shard, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(t)) + 1),
           lambda j: ('0x' || substr(x, 2 * j - 1, 2))::BIGINT)),
           lambda c, y: xor(c >> 8, a[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT t, shard, hex(encode(t)) AS x FROM p), crc
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN h USING (t)""",
}
