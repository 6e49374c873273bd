"""Near duplicates among vectors by spherical-cap filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed, importable, join_checked, read_table
from cohortcheck.llm.graph import components

MIN_COSINE = 0.95
# Filters that a vector exceeds on average, and at least.
FILTERS = 10
LEAST_FILTERS = 6
# Vectors that a filter gets on average; together with the row count it sets the number and height of the caps.
BUCKET = 256
WIDEST = 0.05
# Rows of either side that one task compares at once; larger buckets are compared block by block.
BLOCK = 2048
# Filters that are looked up at once when a task tells which pairs met before.
WIDTH = 1024
SEED = 20240607


@dataclass(frozen=True)
class Caps:
    """Filter directions for one dimension: all concatenations of one code word per part, after a random rotation.

    ``parts`` code books of ``words`` unit vectors give ``words ** parts`` directions at the cost of storing
    ``parts * words`` short vectors; a vector passes a filter if their cosine reaches ``height``.
    """

    dim: int
    parts: int
    words: int
    height: float

    @staticmethod
    def of(dim: int, rows: int) -> Caps:
        share = min(WIDEST, BUCKET / max(1, rows))
        wanted = FILTERS / share
        parts = min(dim, max(2, math.ceil(math.log2(wanted) / 7)))
        words = max(2, math.ceil(wanted ** (1 / parts)))
        return Caps(dim, parts, words, NormalDist().inv_cdf(1 - share) / math.sqrt(dim))

    def books(self) -> tuple[np.ndarray, list[np.ndarray]]:
        draw = np.random.default_rng([SEED, self.dim])
        rotation = np.linalg.qr(draw.standard_normal((self.dim, self.dim)))[0]
        books = []
        for columns in np.array_split(np.arange(self.dim), self.parts):
            book = draw.standard_normal((self.words, len(columns)))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(self.parts))
        return rotation, books


def decode(units: np.ndarray, caps: Caps) -> list[np.ndarray]:
    """Numbers of all filters that each unit vector exceeds, ascending.

    Goes through the parts in turn and drops every prefix that the best words of the remaining parts cannot lift to the
    cap's height. A vector that exceeds too few filters lowers the height for itself.
    """
    rotation, books = caps.books()
    turned = units @ rotation
    splits = np.array_split(np.arange(caps.dim), caps.parts)
    scores = [turned[:, columns] @ book.T for columns, book in zip(splits, books)]
    rest = np.cumsum(np.stack([s.max(axis=1) for s in scores])[::-1], axis=0)[::-1]
    least = min(LEAST_FILTERS, caps.words**caps.parts)
    out = []
    for i in range(len(units)):
        height = caps.height
        while True:
            ids, sums = np.zeros(1, np.int64), np.zeros(1)
            for p, part in enumerate(scores):
                more = rest[p + 1, i] if p + 1 < caps.parts else 0.0
                grid = sums[:, None] + part[i][None, :]
                a, b = np.nonzero(grid + more >= height)
                ids, sums = ids[a] * caps.words + b, grid[a, b]
            if len(ids) >= least:
                break
            height -= 0.05
        out.append(np.sort(ids))
    return out


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """``vec_id, key, dim, raw``; the key is null where the vector can link with nothing."""
    id_kind = dict(vectors.dtypes)["vec_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raws = [], [], []
            for vector in batch.column("embedding").to_pylist():
                x = None
                if vector and None not in vector:
                    x = np.array(vector, kind)
                    x = x + 0.0 if np.isfinite(x).all() and x.any() else None  # no negative zeros
                raw = None if x is None else x.tobytes()
                keys.append(None if x is None else hashlib.md5(raw).digest())
                dims.append(None if x is None else len(x))
                raws.append(raw)
            arrays = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "key", "dim", "raw"])

    return vectors.select("vec_id", "embedding").mapInArrow(work, f"vec_id {id_kind}, key binary, dim int, raw binary")


def _filtered(classes: DataFrame, kind: str, caps: dict[int, Caps]) -> DataFrame:
    """A row per class and filter, with all filters of the class."""
    id_kind = dict(classes.dtypes)["rep"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            raws = batch.column("raw").to_pylist()
            lists: list = [None] * len(raws)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i, ids in zip(at, decode(_units([raws[j] for j in at], kind), caps[int(dim)])):
                    lists[i] = ids
            arrays = [*(batch.column(c) for c in ("rep", "n", "dim", "raw")), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "n", "dim", "raw", "filters"])

    made = classes.select("rep", "n", "dim", "raw").mapInArrow(
        work, f"rep {id_kind}, n long, dim int, raw binary, filters array<long>"
    )
    return made.select("*", F.explode("filters").alias("f"))


def _meet(filters: list[list[int]], before: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` share a filter with a number below ``before``.

    Filters are taken ``WIDTH`` at a time, so that memory is bounded however many there are.
    """
    row = np.repeat(np.arange(len(filters)), [len(ids) for ids in filters])
    name = np.array([x for ids in filters for x in ids], np.int64)
    row, name = row[name < before], name[name < before]
    # Only a filter that several rows exceed can be shared.
    _, place, count = np.unique(name, return_inverse=True, return_counts=True)
    row, place = row[count[place] > 1], place[count[place] > 1]
    place = np.unique(place, return_inverse=True)[1]
    shared = np.zeros((len(a), len(b)), bool)
    for start in range(0, int(place.max(initial=-1)) + 1, WIDTH):
        now = (place >= start) & (place < start + WIDTH)
        member = np.zeros((len(filters), WIDTH), np.float32)
        member[row[now], place[now] - start] = 1
        shared |= member[a] @ member[b].T > 0
    return shared


def _compare(table: pa.Table, kind: str, limit: float) -> pa.Table:
    """Links inside one bucket, or between two of its blocks.

    A pair is counted only in the first filter that both exceed. Returns, for the vectors with links here, how
    many vectors they link with and the smallest vector that they reach.
    """
    rep = np.array(table.column("rep").to_pylist())
    n = np.array(table.column("n").to_pylist(), np.int64)
    block = np.array(table.column("block").to_pylist())
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    here = table.column("f")[0].as_py()
    units = _units(table.column("raw").to_pylist(), kind)
    a = np.flatnonzero(block == low)
    b = a if low == high else np.flatnonzero(block == high)
    links = np.zeros(len(rep), np.int64)
    root = np.arange(len(rep))
    if len(a) and len(b):
        near = units[a] @ units[b].T >= limit
        if low == high:
            np.fill_diagonal(near, False)
        if near.any():
            counted = near & ~_meet(table.column("filters").to_pylist(), here, a, b)
            np.add.at(links, a, counted @ n[b])
            if low != high:
                np.add.at(links, b, n[a] @ counted)
            # Positions in the order of ids, so that the smallest position is the smallest id.
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(rep))
            label = place.copy()
            while True:
                before = label.copy()
                label[a] = np.minimum(label[a], np.where(near, label[b][None, :], len(rep)).min(axis=1))
                label[b] = np.minimum(label[b], np.where(near, label[a][:, None], len(rep)).min(axis=0))
                label = label[order[label]]
                if (label == before).all():
                    break
            root = order[label]
    found = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
    return pa.table({"rep": pa.array(rep[found], table.schema.field("rep").type), "links": pa.array(links[found]),
                     "root": pa.array(rep[root[found]], table.schema.field("rep").type)})


def link(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Equal vectors form one class first, so that copies cost one row. Each class goes to all caps that it exceeds; classes in
    a cap are compared by exact cosine in double precision, in blocks where a cap holds many. Copies are
    counted by their number, never listed. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing, like those of another length. Rows without an id link with nothing and have a null
    component. Repeated rows count as vectors of their own. Further columns (labels) are ignored.
    """
    importable(vectors.sparkSession)
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    id_kind = dict(vectors.dtypes)["vec_id"]
    packed = checkpointed(_packed(vectors, kind))
    usable = packed.where("key IS NOT NULL AND vec_id IS NOT NULL")
    classes = checkpointed(
        usable.groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("raw").alias("raw")
        )
    )
    # A row per dimension that occurs.
    caps = {r["dim"]: Caps.of(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = checkpointed(_filtered(classes, kind, caps))
    sizes = spread.groupBy("dim", "f").agg(F.count(F.lit(1)).alias("size")).where(f"size > {BLOCK}")
    sizes = checkpointed(sizes.select("dim", "f", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    blocked = join_checked(spread, sizes, ["dim", "f"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "n", "raw", "filters", "dim", "f", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    found = checkpointed(
        cells.groupBy("dim", "f", "low", "high").applyInArrow(
            lambda table: _compare(table, kind, min_cosine), f"rep {id_kind}, links long, root {id_kind}"
        )
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("key", "rep", "n")
        .join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("key"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = join_checked(packed.select("vec_id", "key"), checkpointed(per_class), ["key"])
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    alone = F.col("vec_id").isNull()
    return joined.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.when(alone, True).otherwise(F.col("vec_id") == component).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "embeddings"))
