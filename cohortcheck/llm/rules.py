"""Quality rules on whole texts, and verdicts on hosts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import NOT_SPACE, SPACES, checkpointed, join_checked, let, read_table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# A host is rejected if the shrunken share of its documents that fail one of the rules exceeds this.
MAX_HOST_RATE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# What a document may fail, over the columns of ``BASE``.
FAILURES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars AND n_words > 0",
}


def base_counts(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and the five counts of each text.

    A null or empty text counts zero everywhere. Windows of three words are compared by 64-bit hash, and positions
    are sorted only in texts where some hash occurs twice. Nothing leaves the row, whatever its length.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE))
    first = let(
        docs,
        keep,
        _words=words_of(text),
        _lines=lines,
        word_chars=F.char_length(F.regexp_replace(whole, SPACES, "")).cast("long"),
        n_symbols=(F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
    )
    names = [c for c in first.columns if c not in ("_words", "_lines")]
    size = F.size("_words")
    window = F.when(
        size >= 3,
        F.transform(
            F.sequence(F.lit(0), size - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    second = let(
        first,
        names,
        n_words=size.cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _windows=window,
    )
    names += ["n_words", "n_dup_lines"]
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = let(second, names, _sorted=F.when(repeated, placed))

    def twin(i: Column) -> Column:
        here, other = F.get("_sorted", i), lambda j: F.get("_sorted", j)["h"]
        return F.when((other(i - 1) == here["h"]) | (other(i + 1) == here["h"]), here["i"])

    places = F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("_sorted") - 1), twin)))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda acc: acc["n"],
    )
    count = F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long")
    return third.select(*[F.col(f"`{n}`") for n in names], count.alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr(f"({FAILURES['short']}) OR ({FAILURES['repeats']})")


def host_verdicts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, host_rate, host_ok`` from counted documents with a ``host``; a null host is a host of its own.

    For each rule, rates of hosts get a beta prior by the method of moments: its mean is the rate over all documents,
    its strength follows from the spread of rates between hosts beyond that of sampling. A host's rate is
    the mean of its posterior; ``host_rate`` is the largest over the rules. One aggregation by host with partial
    sums, and one over hosts.
    """
    sums = [F.sum(F.expr(cond).cast("long")).alias(rule) for rule, cond in FAILURES.items()]
    hosts = checkpointed(counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums))
    overall = []
    for rule in FAILURES:
        mean = F.sum(rule) / F.sum("n")
        overall += [
            mean.alias(f"{rule}_mean"),
            F.avg(F.pow(F.col(rule) / F.col("n"), 2)).alias(f"{rule}_square"),
            F.avg(F.col(rule) / F.col("n")).alias(f"{rule}_avg"),
        ]
    # One row of sums over all hosts.
    prior = hosts.agg(*overall, F.avg(1 / F.col("n")).alias("inverse")).first()
    rates = []
    for rule in FAILURES:
        mean = prior[f"{rule}_mean"] or 0.0
        bound = mean * (1 - mean)
        spread = (prior[f"{rule}_square"] or 0.0) - (prior[f"{rule}_avg"] or 0.0) ** 2 - bound * (prior["inverse"] or 0.0)
        strength = min(max(bound / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
        rates.append((F.col(rule) + mean * strength) / (F.col("n") + strength))
    rate = F.greatest(*rates)
    return hosts.select("host", rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def host_key(source: Column) -> Column:
    """A key that no null can take: nulls join like any other host."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: counts, ``base_failed``, ``host_rate``, ``kept``.

    A document is kept if it passes the base rules and its host the shrunken rates. Null ids, repeated rows and
    further columns are allowed; an empty table gives an empty result.
    """
    keep = [F.col("doc_id"), host_key(F.col("source")).alias("host")]
    counted = checkpointed(base_counts(docs.select("doc_id", "text", "source"), keep, F.col("text")))
    verdicts = checkpointed(host_verdicts(counted, max_rate))
    joined = join_checked(counted, verdicts, ["host"])
    return joined.select(
        "doc_id",
        *BASE,
        base_failed().alias("base_failed"),
        F.round("host_rate", 6).alias("host_rate"),
        (~base_failed() & F.col("host_ok")).alias("kept"),
    )


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    Texts are counted twice, once for the hosts and once for the rows, since that costs less at scale than
    to shuffle or store every text a second time.
    """
    counted = base_counts(docs, [host_key(F.col("source")).alias("host")], F.col("text"))
    verdicts = checkpointed(host_verdicts(counted, max_rate))
    packed = docs.select(F.struct("*").alias("row"), host_key(F.col("source")).alias("host"))
    good = join_checked(packed, verdicts.where("host_ok").select("host"), ["host"], "left_semi")
    tested = base_counts(good, [F.col("row")], F.col("row.text"))
    return tested.where(~base_failed()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


# DuckDB: windows are compared as lists of words, priors spelt out rule by rule.
_SQL_RATES = ", ".join(
    f"({r} + {r}_mean * {r}_strength) / (n + {r}_strength)" for r in FAILURES
)
_SQL_PRIOR = ", ".join(
    f"sum({r}) / sum(n) AS {r}_mean, avg(({r} / n) ** 2) - avg({r} / n) ** 2 "
    f"- (sum({r}) / sum(n)) * (1 - sum({r}) / sum(n)) * avg(1 / n) AS {r}_spread"
    for r in FAILURES
)
_SQL_STRENGTH = ", ".join(
    f"CASE WHEN {r}_spread > 0 THEN least(greatest({r}_mean * (1 - {r}_mean) / {r}_spread - 1, 1.0), 1000.0) "
    f"ELSE 1000.0 END AS {r}_strength"
    for r in FAILURES
)
SQL = {
    "op4_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS host FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i+1], words[i+2]) AS c
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g WHERE c > 1) GROUP BY doc_id
), b AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT host, count(*)::DOUBLE AS n, {", ".join(f"sum(({c})::INT)::DOUBLE AS {r}" for r, c in FAILURES.items())}
  FROM b GROUP BY host
), p AS (SELECT {_SQL_PRIOR} FROM f
), s AS (SELECT *, {_SQL_STRENGTH} FROM p
), h AS (SELECT host, greatest({_SQL_RATES}) AS rate FROM f, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({FAILURES['short']}) OR ({FAILURES['repeats']}) AS base_failed,
       round(rate, 6) AS host_rate,
       NOT (({FAILURES['short']}) OR ({FAILURES['repeats']})) AND rate <= {MAX_HOST_RATE} AS kept
FROM b JOIN h USING (host)""",
}
