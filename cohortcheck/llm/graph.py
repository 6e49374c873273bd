"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links(a, b)``.

    Alternates the two star steps of Kiveris et al. ("Connected Components in MapReduce and Beyond"): every node
    hands its larger neighbours, then its smaller ones, to the smallest node it knows. Rows never
    outnumber the links, and each round is cut off by a checkpoint. Links to itself and nulls are ignored.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = checkpointed(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")
        )
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        links = checkpointed(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
