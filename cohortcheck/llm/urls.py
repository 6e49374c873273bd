"""URL filters: rules on hosts and paths, and pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import read_table

# Verdict, host, path. The longest rule that fits decides.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@dataclass(frozen=True)
class Pattern:
    """A pattern rule: ``*`` stands for anything, ``^`` for a separator or the end, the rest for itself."""

    name: str
    glob: str
    verdict: str

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": r"(?:[^a-z0-9]|$)"}
        return "".join(parts.get(c) or re.escape(c) for c in self.glob.lower())

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that a url must hold as whole tokens for the rule to fit."""
        return [
            m[0]
            for m in re.finditer(r"[a-z0-9]+", self.glob.lower())
            if m.start() > 0 and self.glob[m.start() - 1] != "*" and m.end() < len(self.glob) and self.glob[m.end()] != "*"
        ]


# In order of precedence; they decide where no host rule fits.
PATTERNS = [
    Pattern("trusted-docs", "/docs/license^", "allow"),
    Pattern("spam-farm", "/spam-farm.", "block"),
    Pattern("spam-farm-sub", ".spam-farm.", "block"),
    Pattern("link-farm", "/link-farm.", "block"),
    Pattern("casino", "^casino^", "block"),
    Pattern("adult", "^xxx^", "block"),
    Pattern("pills", "^viagra^", "block"),
    Pattern("phishing", "^phishing^", "block"),
    Pattern("ads", "/ads/*banner^", "block"),
    Pattern("tracker", "//tracker.*/pixel^", "block"),
    Pattern("click", "^clickbait^", "block"),
    Pattern("binary", ".exe^", "block"),
    Pattern("feed-spam", "^utm_source=spam^", "block"),
]
DEFAULT = "allow"


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise("")
    return _lower(F.regexp_extract(after, "^[^/?#]*", 0)), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def _fit(host: str, path: str) -> Column:
    on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return on_host & F.col("path").startswith(path)


def rarest_tokens(urls: DataFrame, patterns: list[Pattern]) -> dict[str, str | None]:
    """Each rule's token that fewest urls hold; None for a rule without a token, which every url must try.

    One pass over all urls counts the rules' own tokens only, so no more rows leave the tasks than the rules have
    tokens.
    """
    wanted = sorted({t for p in patterns for t in p.tokens})
    counts: dict[str, int] = {}
    if wanted:
        tokens = F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
        found = urls.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()
        counts = {r["t"]: r["count"] for r in found}
    return {p.name: min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None) for p in patterns}


class Index:
    """Rules by their rarest token."""

    def __init__(self, patterns: list[Pattern], rarest: dict[str, str | None]):
        self.rules = [(re.compile(p.regex, re.S), p.name, p.verdict) for p in patterns]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(patterns):
            token = rarest[p.name]
            (self.always if token is None else self.by_token.setdefault(token, [])).append(i)

    def first(self, url: str | None) -> tuple[str | None, str | None, int]:
        """Name and verdict of the first rule that fits, and how many regular expressions were tried."""
        url = (url or "").lower()
        candidates = set(self.always)
        for token in set(re.findall(r"[a-z0-9]+", url)):
            candidates.update(self.by_token.get(token, ()))
        for tried, i in enumerate(sorted(candidates), start=1):
            regex, name, verdict = self.rules[i]
            if regex.search(url):
                return name, verdict, tried
        return None, None, len(candidates)


def judge_urls(
    pages: DataFrame,
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    patterns: list[Pattern] = PATTERNS,
    default: str = DEFAULT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern, n_tried`` for every row of ``pages(page_id, url)``.

    Host rules decide first, by the longest rule that fits. Where none does, the pattern rules decide in their order, else
    ``default``. Null urls and urls without ``://`` have an empty host and path, and are judged by patterns
    like the others. Both rule sets are parameters of the job and travel with the tasks; nothing else is shuffled
    than counts of the rules' tokens.
    """
    urls = pages.select("page_id", "url")
    index = Index(patterns, rarest_tokens(urls, patterns))
    schema = "page_id {}, url string, pattern string, pattern_verdict string, n_tried int".format(dict(urls.dtypes)["page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.first(url) for url in batch.column("url").to_pylist()]
            name, verdict, tried = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(name, pa.string()), pa.array(verdict, pa.string()), pa.array(tried, pa.int32())],
                ["page_id", "url", "pattern", "pattern_verdict", "n_tried"],
            )

    judged = urls.mapInArrow(search, schema).withColumn("_u", F.coalesce("url", F.lit("")))
    host, path = host_and_path(F.col("url"))
    placed = judged.select("page_id", host.alias("host"), path.alias("path"), "pattern", "pattern_verdict", "n_tried")
    rule, verdict = F.lit(None).cast("string"), F.coalesce("pattern_verdict", F.lit(default))
    for said, on, at in sorted(host_rules, key=lambda r: len(r[1] + r[2])):
        fits = _fit(on, at)
        rule = F.when(fits, on + at).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "pattern", "n_tried")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages")).drop("n_tried")


def _sql() -> str:
    rules = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    found = " ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), '{p.regex}') THEN '{p.name}'" for p in PATTERNS)
    meant = " ".join(f"WHEN pattern = '{p.name}' THEN '{p.verdict}'" for p in PATTERNS)
    return f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, CASE {found} END AS pattern
  FROM u
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {said} ELSE CASE {meant} ELSE '{DEFAULT}' END END AS verdict, pattern
FROM h"""


SQL = {"op8_url_filter": _sql()}
