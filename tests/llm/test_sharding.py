"""op12 against a plain heap, and its laws on odd tables."""

import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcheck.llm import sharding
from tests.llm.test_operators import DOCS, ODD


def brute_schedule(sizes, counts, shards):
    heap, out = [(0, j) for j in range(shards)], np.zeros((len(sizes), shards), int)
    for i, (size, count) in enumerate(zip(sizes, counts)):
        for _ in range(count):
            load, j = heap[0]
            out[i, j] += 1
            heapq.heapreplace(heap, (load + size, j))
    return out.cumsum(axis=1).tolist(), [load for load, _ in sorted(heap, key=lambda pair: pair[1])]


@pytest.mark.parametrize("short_run", [0, 1, 64])
def test_schedule_is_that_of_the_heap(monkeypatch, short_run):
    monkeypatch.setattr(sharding, "SHORT_RUN", short_run)
    random.seed(short_run)
    for _ in range(300):
        sizes = np.array(sorted(random.sample(range(1, random.choice([20, 1000])), random.randint(1, 12)), reverse=True))
        counts = np.array([random.choice([1, 1, 2, 5, 100, random.randint(1, 40)]) for _ in sizes])
        shards = random.choice([1, 2, 3, 8])
        ends, loads = sharding.schedule(sizes, counts, shards)
        assert (ends.tolist(), loads) == brute_schedule(sizes, counts, shards)


def check(rows, shards, texts):
    """The laws of the result: equal texts together, slots without gaps, the shares of the heap."""
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    of_text, slots, loads, sizes = {}, defaultdict(list), [0] * shards, defaultdict(int)
    for r in rows:
        assert of_text.setdefault(r["text_digest"], r["shard"]) == r["shard"] and r["law"] == "bytes"
        slots[r["shard"]].append((r["slot"], r["doc_id"] is None, r["doc_id"] or 0))
        loads[r["shard"]] += r["size"]
        sizes[r["text_digest"]] += r["size"]
    for found in slots.values():
        found.sort()
        assert [s for s, *_ in found] == list(range(len(found)))
        assert [i for _, *i in found] == sorted(i for _, *i in found)
    distinct = sorted(set(sizes.values()), reverse=True)
    counts = [sum(s == d for s in sizes.values()) for d in distinct]
    assert loads == brute_schedule(distinct, counts, shards)[1]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_groups_and_slots(spark, shards):
    random.seed(shards)
    texts = [(i, "x" * random.randint(0, 30) + random.choice(["", "é", "日"])) for i in range(200)]
    # One text holds a third of all rows.
    texts += [(i, "the same text") for i in range(200, 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = sharding.assign(df, shards).collect()
    check(rows, shards, texts)
    by_id = dict(texts)
    for r in rows:
        raw = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame(ODD, DOCS)
    rows = sharding.assign(odd, 3).collect()
    check(rows, 3, [(i, t) for i, t, *_ in ODD])
    # Null and empty texts are one group, of one byte a row.
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert sharding.assign(odd.limit(0)).count() == 0
    named = odd.selectExpr("doc_id", "text", "lang AS shard", "host AS size", "row AS bytes", "source AS slot")
    assert sharding.assign(named, 3).count() == len(ODD)
    with pytest.raises(ValueError, match="shard"):
        sharding.write(named, str(tmp_path / "clash"), 3)


def test_groups_of_ones_own(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', CAST(id AS INT)) AS text", "id % 7 AS site")
    found = sharding.assign(docs, 4, together=F.col("site")).join(docs, "doc_id")
    assert found.groupBy("site").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 9} " * (i % 9)) for i in range(50)], "doc_id long, text string")
    sharding.write(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    wanted = {(r["doc_id"], r["shard"]) for r in sharding.assign(docs, 3).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == wanted
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in docs.collect())
