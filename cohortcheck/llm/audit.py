"""What each filter of a chain removes, in every order of the filters, from relations of failing ids."""

from __future__ import annotations

import json
import uuid
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import (
    checkpointed,
    join_checked,
    let,
    read_table,
    remove_folder,
    shared_folder,
    text_digest,
    words_of,
)

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# What a document must show to fail, over the columns that ``measure`` makes.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "has_symbol",
    "E": "doc_id > first_id",
}

_ROW = "part string, row long, good int, toxic int"


def measure(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: a ``row`` number, ``part`` (the language, null as empty text), the counts that
    the filters need, and ``first_id``, the smallest id with the same whole text.

    Null texts are empty. Rows without an id have no place among ids: they are no copy, and no other is theirs.
    Texts are compared by SHA-256, so that ids and digests move instead of texts; a text that fills a third of
    all rows is one row of the aggregation, and adaptive execution splits its partition in the join.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")]
    first = let(
        docs.select("doc_id", "text", "lang"),
        keep,
        _words=words_of(F.col("text")),
        digest=text_digest(F.col("text")),
        n_points=F.char_length(whole).cast("long"),
        n_capitals=(F.char_length(whole) - F.char_length(F.translate(whole, CAPITALS, ""))).cast("long"),
        has_symbol=whole.rlike("[#$%&*|]"),
    )
    counted = first.select(
        "doc_id", "part", "digest", "n_points", "n_capitals", "has_symbol",
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.monotonically_increasing_id().alias("row"),
    )
    stored = checkpointed(counted)
    copies = stored.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("doc_id").alias("_n"))
    return stored.join(copies.where("_n > 1").drop("_n"), "digest", "left")


def _id_tables(facts: DataFrame, filters: dict[str, str], folder: str) -> dict[str, DataFrame]:
    """One table of failing rows per filter, each in a folder of its own below ``folder``, written in one job."""
    names = F.array_compact(F.array(*[F.when(F.expr(fails), F.lit(name)) for name, fails in filters.items()]))
    failing = facts.select("part", "row", "good", "toxic", F.explode(names).alias("filter"))
    failing.write.partitionBy("filter").parquet(folder)
    tables = facts.sparkSession.read.schema(f"{_ROW}, filter string").parquet(folder)
    return {name: tables.where(F.col("filter") == name).drop("filter") for name in filters}


def prefix_counts(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What a filter removes after each set of others, and what it finds removed.

    First ``part, f, before, removed, good_lost, toxic_lost``: the failing rows of filter number ``f`` that a left-anti join
    with the table of each filter in ``before`` (a sum of powers of two) leaves. Then ``part, f, before, x, gone``: those
    that a left-semi join finds in the table of filter ``x``, but not in those of ``before``, which stand ahead of ``x``.

    Filters are joined one after the other; at each, a row stands once with the filter among those before and once
    without. Every join is by ``row``, so rows are shuffled by it once and stay where they are.
    """
    rows = None
    for f, table in enumerate(tables.values()):
        own = table.select(F.lit(f).alias("f"), F.lit(0).alias("before"), "part", "row", "good", "toxic")
        rows = own if rows is None else rows.union(own)
    rows = rows.repartition("row")
    gone = None
    for x, table in enumerate(tables.values()):
        found = table.select(F.col("row").alias("_other"))
        same = F.col("row") == F.col("_other")
        here = rows.where(F.col("f") != x).join(found, same, "left_semi").groupBy("part", "f", "before")
        here = here.agg(F.count(F.lit(1)).alias("gone")).select("part", "f", "before", F.lit(x).alias("x"), "gone")
        gone = here if gone is None else gone.union(here)
        without = F.struct(F.lit(False).alias("probe"), F.col("before"))
        after = F.struct(F.lit(True).alias("probe"), F.col("before").bitwiseOR(1 << x).alias("before"))
        choices = F.when(F.col("f") == x, F.array(without)).otherwise(F.array(without, after))
        both = rows.select("f", "part", "row", "good", "toxic", F.explode(choices).alias("_c"))
        both = both.select("f", "_c.before", "part", "row", "good", "toxic", "_c.probe")
        rows = both.join(found, same & F.col("probe"), "left_anti").drop("probe")
    sums = [F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")]
    return rows.groupBy("part", "f", "before").agg(*sums), gone


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters, and step in it: how many documents the step keeps, removes and loses.

    ``docs(doc_id, text, lang)``; ``labels(doc_id, quality, toxic)`` may hold several rows of an id, of which one with the
    label is enough, and nulls, which are no label. Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; zeros included, so a part without failing rows has all its rows too. Repeated
    rows count one by one; an empty table gives an empty result; whole texts are measured, however long.

    The rows that fail a filter, and not the texts, are written to a table per filter below the shared folder, joined there
    (:func:`prefix_counts`), and removed. All that follows are sums over at most ``filters * 2^(filters - 1)`` rows per part.
    """
    filters = filters or FILTERS
    spark = docs.sparkSession
    number = {name: i for i, name in enumerate(filters)}
    measured = checkpointed(measure(docs))
    totals = checkpointed(measured.groupBy("part").agg(F.count(F.lit(1)).alias("total")))

    label = [F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*label)
    fails = F.lit(False)
    for condition in filters.values():
        fails = fails | F.coalesce(F.expr(condition), F.lit(False))
    joined = join_checked(measured.where(fails), checkpointed(known), ["doc_id"])
    facts = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})

    folder = f"{shared_folder(spark)}/failing-{uuid.uuid4()}"
    removed, gone = prefix_counts(_id_tables(facts, filters, folder))
    removed, gone = checkpointed(removed), checkpointed(gone)
    remove_folder(spark, folder)

    full = (1 << len(filters)) - 1
    parts_of = []
    for f in number.values():
        others = [x for x in number.values() if x != f]
        for chosen in (c for n in range(len(others) + 1) for c in combinations(others, n)):
            before = sum(1 << x for x in chosen)
            parts_of += [{"f": f, "set": before, "x": x, "before": before & ((1 << x) - 1)} for x in chosen]
    # Each removed row is met first by one filter of the set, in the order of the tables.
    shares = _literal(spark, parts_of, "f int, set int, x int, before int")
    redundant = gone.join(F.broadcast(shares), ["f", "x", "before"]).groupBy("part", "f", F.col("set").alias("before"))
    redundant = redundant.agg(F.sum("gone").alias("redundant"))
    alone = removed.where(F.col("before") == F.lit(full) - F.expr("shiftleft(1, f)"))
    alone = alone.select("part", "f", F.col("removed").alias("unique_fails"))

    steps = []
    for order in permutations(filters):
        for step, name in enumerate(order, 1):
            before = sum(1 << number[n] for n in order[: step - 1])
            steps.append({"filter_order": "".join(order), "step": step, "f": number[name], "before": before})
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,before:int>>")
    grid = totals.select("part", "total", F.inline(plan))
    out = grid.join(removed, ["part", "f", "before"], "left").join(redundant, ["part", "f", "before"], "left")
    out = out.join(alone, ["part", "f"], "left")
    counts = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    out = out.select("part", "filter_order", "step", "f", "total", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.selectExpr(
        "part", "filter_order", "step",
        "total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS kept",
        *counts,
        "sum(removed) OVER (PARTITION BY part, f) AS shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


# DuckDB: a mask of failed filters per document, and sums over masks.
SQL = {
    "op13_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), m AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
  FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r""",
}
