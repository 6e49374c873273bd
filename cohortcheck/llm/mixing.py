"""Mixing sources to target weights by raking, and sampling with the calibrated rates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed, join_checked, let, read_table, small_enough, words_of

# Margin -> exponent: the target share of a value is its share of all tokens to this power, scaled to sum to one.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
ROUNDS = 8
# Expected share of all tokens in the sample.
BUDGET = 0.5
SEED = "mix"

TOPICS = [
    ("table", "contains(t, ' | ')"),
    ("license", "regexp_like(t, '(?i)licen[sc]e')"),
    ("contact", "contains(t, '@')"),
    ("shout", "contains(t, '!! ')"),
]


def topic_of(text: Column) -> Column:
    """What kind of text it is, by the first marker found anywhere in it; ``prose`` without one."""
    marks = {
        "table": text.contains(" | "),
        "license": text.rlike("(?i)licen[sc]e"),
        "contact": text.contains("@"),
        "shout": text.contains("!! "),
    }
    out = F.lit("prose")
    for topic, _ in reversed(TOPICS):
        out = F.when(marks[topic], topic).otherwise(out)
    return out


def rake(cells: DataFrame, exponents: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """Iterative proportional fitting of ``cells(<margins>, tokens)``; adds ``weight``, which sums to one.

    A weight is tokens times one factor per margin. Each step sets the factors of one margin so that its sums meet their
    targets: one aggregation of the cells by its value. Cells are one row per combination that occurs, however many
    documents there are; each step ends with a checkpoint of the factors. Values without tokens get weight zero. An
    empty table stays empty.
    """
    targets = {}
    for margin, power in exponents.items():
        by = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("_target"))
        total = by.agg(F.sum("_target")).first()[0] or 1.0
        by = checkpointed(by.select(margin, (F.col("_target") / total).alias("_target"), F.lit(1.0).alias(f"{margin}_factor")))
        targets[margin] = by, small_enough(by)

    def hinted(table: DataFrame, margin: str) -> DataFrame:
        # The values of a margin do not change, so its size is measured once.
        return F.broadcast(table) if targets[margin][1] else table

    def weighted(chosen: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
        joined, weight = cells, F.col("tokens").cast("double")
        for margin, table in chosen.items():
            joined = joined.join(hinted(table, margin), margin)
            weight = weight * F.col(f"{margin}_factor")
        return joined, weight

    factors = {margin: by.drop("_target") for margin, (by, _) in targets.items()}
    for _ in range(rounds):
        for margin in exponents:
            joined, weight = weighted({m: t for m, t in factors.items() if m != margin})
            sums = joined.groupBy(margin).agg(F.sum(weight).alias("_sum"))
            scale = F.when(F.col("_sum") > 0, F.col("_target") / F.col("_sum")).otherwise(0.0).alias(f"{margin}_factor")
            target = hinted(targets[margin][0].select(margin, "_target"), margin)
            factors[margin] = checkpointed(sums.join(target, margin).select(margin, scale))
    joined, weight = weighted(factors)
    return joined.select(*exponents, "tokens", weight.alias("weight"))


def _known(column: Column) -> Column:
    """Margins as text that is never null, so that nulls are a value like any other."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def _margins(source: Column, lang: Column, text: Column) -> list[Column]:
    return [
        _known(source).alias("source"),
        _known(lang).alias("lang"),
        topic_of(F.coalesce(text, F.lit(""))).alias("topic"),
    ]


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{SEED}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def rates(cells: DataFrame, exponents: dict[str, float], budget: float, rounds: int) -> DataFrame:
    """``<margins>, probability`` per cell: weight over tokens, scaled to the budget and at most one.

    A cell without tokens costs nothing and gets one.
    """
    fitted = rake(cells, exponents, rounds)
    total = fitted.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    wanted = F.lit(budget * total) * F.col("weight") / F.col("tokens")
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), wanted)).otherwise(1.0)
    return checkpointed(fitted.select(*exponents, F.round(probability, 9).alias("probability")))


def mix(
    docs: DataFrame, exponents: dict[str, float] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, kept`` for every row of ``docs``.

    Tokens are words of the whole text; null and empty texts have none. Nulls in the margins count as a value of their
    own. Rows with the same id share the draw. Further columns are ignored.
    """
    counted = checkpointed(
        docs.select(
            "doc_id",
            F.col("source").alias("given_source"),
            F.col("lang").alias("given_lang"),
            *_margins(F.col("source"), F.col("lang"), F.col("text")),
            F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"),
        )
    )
    cells = checkpointed(counted.groupBy(*exponents).agg(F.sum("n_tokens").alias("tokens")))
    joined = join_checked(counted, rates(cells, exponents, budget, rounds), list(exponents))
    return joined.select(
        "doc_id",
        F.col("given_source").alias("source"),
        F.col("given_lang").alias("lang"),
        "topic",
        "n_tokens",
        "probability",
        (draw(F.col("doc_id")) < F.col("probability")).alias("kept"),
    )


def sample(
    docs: DataFrame, exponents: dict[str, float] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS
) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns."""
    source, lang, text = (F.col(c) for c in ("source", "lang", "text"))
    counted = docs.select(*_margins(source, lang, text), F.size(words_of(text)).cast("long").alias("n_tokens"))
    cells = checkpointed(counted.groupBy(*exponents).agg(F.sum("n_tokens").alias("tokens")))
    found = rates(cells, exponents, budget, rounds)
    packed = let(docs, [F.struct("*").alias("row")], key=F.struct(*_margins(source, lang, text)))
    packed = packed.select("row", "key.*")
    joined = join_checked(packed, found, list(exponents))
    return joined.where(draw(F.col("row.doc_id")) < F.col("probability")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    margins = list(TARGETS)
    cases = " ".join(f"WHEN {c.replace('regexp_like', 'regexp_matches')} THEN '{t}'" for t, c in TOPICS)
    parts = [
        f"""d AS (
  SELECT doc_id, source AS given_source, lang AS given_lang, coalesce('+' || source, '-') AS source,
         coalesce('+' || lang, '-') AS lang, CASE {cases} ELSE 'prose' END AS topic,
         len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
)""",
        f"c AS MATERIALIZED (SELECT {', '.join(margins)}, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for margin, power in TARGETS.items():
        parts.append(
            f"t_{margin} AS MATERIALIZED (SELECT {margin}, pow(sum(tokens), {power}) "
            f"/ sum(pow(sum(tokens), {power})) OVER () AS t FROM c GROUP BY {margin})"
        )
        parts.append(f"f0_{margin} AS (SELECT {margin}, 1.0::DOUBLE AS {margin}_factor FROM t_{margin})")
    latest = {m: f"f0_{m}" for m in margins}
    for step in range(1, ROUNDS + 1):
        for margin in margins:
            others = [m for m in margins if m != margin]
            joins = " ".join(f"JOIN {latest[m]} USING ({m})" for m in others)
            weight = " * ".join(["tokens", *(f"{m}_factor" for m in others)])
            parts.append(
                f"f{step}_{margin} AS MATERIALIZED (SELECT {margin}, CASE WHEN s > 0 THEN t / s ELSE 0.0 END "
                f"AS {margin}_factor FROM (SELECT {margin}, sum({weight}) AS s FROM c {joins} GROUP BY {margin}) "
                f"JOIN t_{margin} USING ({margin}))"
            )
            latest[margin] = f"f{step}_{margin}"
    joins = " ".join(f"JOIN {latest[m]} USING ({m})" for m in margins)
    weight = " * ".join(["tokens", *(f"{m}_factor" for m in margins)])
    parts.append(f"w AS (SELECT {', '.join(margins)}, tokens, {weight} AS weight FROM c {joins})")
    parts.append(
        f"p AS (SELECT {', '.join(margins)}, CASE WHEN tokens > 0 THEN round(least(1.0, "
        f"{BUDGET} * (SELECT sum(tokens) FROM c) * weight / tokens), 9) ELSE 1.0 END AS probability FROM w)"
    )
    return f"""WITH {', '.join(parts)}
SELECT doc_id, given_source AS source, given_lang AS lang, topic, n_tokens, probability,
       ('0x' || substr(md5(doc_id || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0 < probability AS kept
FROM d JOIN p USING ({', '.join(margins)})"""


SQL = {"op7_mixing": _sql()}
