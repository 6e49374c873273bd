"""Quality classifier: evidence of the document, shrunken through its path and host (hierarchical empirical Bayes)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import NOT_SPACE, checkpointed, join_checked, let, read_table, words_of

# A document is rejected if its probability of being good falls below this.
LEAST_GOOD = 0.5
FEATURES = ["symbols", "capitals", "marks", "bars", "digits", "variety", "lines", "length"]
BINS = 21


@dataclass(frozen=True)
class Model:
    """Log likelihood ratio (good over bad) of each bin of each feature, and the share of good labels."""

    ratios: Mapping[tuple[int, int], float]
    base: float


def _share(part: Column, whole: Column, steps: int) -> Column:
    """Bin of a share: ``steps`` bins to one, the last one open."""
    share = F.when(whole > 0, part / whole).otherwise(0.0)
    return F.least(F.ceil(share * steps), F.lit(BINS - 1)).cast("int")


def binned(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and ``bins``, one small number per feature, from the whole text; null and empty texts are in bin 0."""
    whole = F.coalesce(text, F.lit(""))

    def without(characters: str) -> Column:
        return F.char_length(whole) - F.char_length(F.translate(whole, characters, ""))

    capitals = F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"\p{Lu}", ""))
    first = let(
        docs,
        keep,
        _chars=F.char_length(whole),
        _words=words_of(text),
        _lines=F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE)),
        _symbols=without("#*$%&<>"),
        _capitals=capitals,
        _marks=without("!?"),
        _bars=without("|"),
        _digits=without("0123456789"),
    )
    names = first.columns[: len(first.columns) - 8]
    n_words, chars = F.size("_words"), F.col("_chars")
    bins = [
        _share(F.col("_symbols"), chars, 100),
        _share(F.col("_capitals"), chars, 40),
        _share(F.col("_marks"), chars, 100),
        _share(F.col("_bars"), chars, 100),
        _share(F.col("_digits"), chars, 100),
        _share(F.size(F.array_distinct("_words")), n_words, 20),
        _share(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines"), 20),
        F.least(F.ceil(F.log2(n_words + 1)), F.lit(BINS - 1)).cast("int"),
    ]
    return first.select(*[F.col(f"`{n}`") for n in names], F.array(*bins).alias("bins"))


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """Naive Bayes over the bins, from all labelled documents.

    ``features(doc_id, bins)`` and ``labels(doc_id, quality)`` meet in one join of a few bytes per row; what comes back is
    a count per feature, bin and label (at most ``2 * BINS * len(FEATURES)`` rows). Several labels of a
    document count as good if one is; null labels are ignored. Without labels every ratio is zero.
    """
    said = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pairs = features.join(said, "doc_id").select("quality", F.posexplode("bins").alias("feature", "bin"))
    rows = pairs.groupBy("feature", "bin", "quality").count().collect()
    seen = {(r["feature"], r["bin"], int(r["quality"] > 0)): r["count"] for r in rows}
    total = [sum(n for (f, _, q), n in seen.items() if f == 0 and q == side) for side in (0, 1)]
    ratios = {}
    for feature, at in {(f, b) for f, b, _ in seen}:
        good, bad = ((seen.get((feature, at, q), 0) + 0.5) / (total[q] + 0.5 * BINS) for q in (1, 0))
        ratios[feature, at] = math.log(good / bad)
    return Model(ratios, (total[1] + 1) / (sum(total) + 2))


def evidence(model: Model, bins: Column) -> Column:
    """Sum of the ratios of a document's bins; a bin that no label has seen says nothing."""
    out = F.lit(0.0)
    for feature in range(len(FEATURES)):
        found = sorted((at, r) for (f, at), r in model.ratios.items() if f == feature)
        if found:
            table = F.create_map(*[F.lit(x) for pair in found for x in pair])
            out = out + F.coalesce(F.try_element_at(table, bins[feature]), F.lit(0.0))
    return out


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(mean: float | None, spread: float | None) -> float:
    """Weight of a beta prior in documents, from its mean and the variance between groups."""
    if mean is None or spread is None or spread <= 0:
        return 1000.0
    return min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)


def sites(scored: DataFrame, base: float) -> DataFrame:
    """``host, path, host_good, path_good``: posterior shares of good documents, shrunken towards the level above.

    Each document counts with its probability under the overall base rate. One aggregation by host and path with partial
    sums feeds all: hosts are sums of paths. Hosts shrink to the overall share, paths to their host, with strengths from
    the variance between hosts and between the paths of a host.
    """
    good = _logistic(F.col("evidence") + math.log(base / (1 - base)))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("s")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    share = F.col("host_s") / F.col("host_n")
    top = hosts.agg(
        (F.sum("host_s") / F.sum("host_n")).alias("mean"), F.var_pop(share).alias("var"), F.avg(1 / F.col("host_n")).alias("inverse")
    ).first()
    mean = top["mean"] if top["mean"] is not None else base
    between = _strength(mean, (top["var"] or 0.0) - mean * (1 - mean) * (top["inverse"] or 0.0))
    hosts = hosts.withColumn("host_good", (F.col("host_s") + mean * between) / (F.col("host_n") + between))
    hosts = checkpointed(hosts)
    joined = join_checked(paths, hosts, ["host"])
    off = F.pow(F.col("s") / F.col("n") - share, 2) - share * (1 - share) / F.col("n")
    within = _strength(mean, joined.agg(F.avg(off)).first()[0])
    path_good = (F.col("s") + F.col("host_good") * within) / (F.col("n") + within)
    return checkpointed(joined.select("host", "path", "host_good", path_good.alias("path_good")))


def _key(column: Column) -> Column:
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def _score() -> Column:
    prior = F.least(F.greatest(F.col("path_good"), F.lit(0.001)), F.lit(0.999))
    return _logistic(F.col("evidence") + F.log(prior / (1 - prior)))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST_GOOD) -> DataFrame:
    """``doc_id, score, host_good, path_good, kept`` for every row of ``docs``.

    ``score`` is the probability of a good document: its own evidence, with the posterior of its path as prior. ``host`` and
    ``path`` name the columns of the site; nulls are a site of their own. Null texts count as empty. Rows without an id are
    scored but have no label. Repeated rows count as often as they occur. Further columns are ignored.
    """
    keep = [F.col("doc_id"), _key(F.col(host)).alias("host"), _key(F.col(path)).alias("path")]
    features = checkpointed(binned(docs.select("doc_id", "text", *{host, path}), keep, F.col("text")))
    model = fit(features.select("doc_id", "bins"), labels)
    scored = features.select("doc_id", "host", "path", evidence(model, F.col("bins")).alias("evidence"))
    joined = join_checked(scored, sites(scored, model.base), ["host", "path"])
    return joined.select("doc_id", _score().alias("score"), "host_good", "path_good", (_score() >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST_GOOD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns.

    Features are computed a second time for the rows themselves, which is cheaper than to shuffle whole texts by id.
    """
    keep = [F.col("doc_id"), _key(F.col(host)).alias("host"), _key(F.col(path)).alias("path")]
    features = checkpointed(binned(docs, keep, F.col("text")))
    model = fit(features.select("doc_id", "bins"), labels)
    found = sites(features.select("host", "path", evidence(model, F.col("bins")).alias("evidence")), model.base)
    keep = [F.struct("*").alias("row"), _key(F.col(host)).alias("host"), _key(F.col(path)).alias("path")]
    rows = binned(docs, keep, F.col("text")).select("row", "host", "path", evidence(model, F.col("bins")).alias("evidence"))
    return join_checked(rows, found, ["host", "path"]).where(_score() >= least).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
