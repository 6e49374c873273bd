"""Importance resampling towards a target distribution, by hashed word features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed, importable, join_checked, numbered, read_table

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7

# Texts are hashed so many bytes at a time; a longer text stands alone.
PIECE_BYTES = 1 << 21
# Features of more bytes would be a matrix of many columns and few rows; they are hashed one by one.
WIDEST = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# Bytes of a word, once lower-cased: digits, a to z, and all of a character beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 (the reflected polynomial of zlib and PNG)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_by_length(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings ``data[offsets[i]:offsets[i + 1]]``.

    Strings of equal length form a matrix with a column per byte; all their CRCs take in one column after the other,
    and are scattered back to the places of the strings.
    """
    lengths = np.diff(offsets)
    out = np.empty(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for first, end in zip(edges[:-1], edges[1:]):
        members = order[first:end]
        width = int(lengths[members[0]])
        starts = offsets[members]
        if width > WIDEST:
            out[members] = [zlib.crc32(data[s : s + width]) for s in starts]
            continue
        crc = np.full(len(members), 0xFFFFFFFF, np.uint32)
        for column in data[starts + np.arange(width)[:, None]]:
            crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[members] = ~crc
    return out


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, …`` of all ranges, one after the other."""
    return np.repeat(starts - np.concatenate(([0], lengths.cumsum()[:-1])), lengths) + np.arange(lengths.sum())


def _joined(a: tuple[np.ndarray, np.ndarray], left: np.ndarray, b: tuple[np.ndarray, np.ndarray], right: np.ndarray):
    """The strings ``left`` of ``a`` and ``right`` of ``b``, pair by pair with a space between, as data and offsets."""
    n, m = np.diff(a[1])[left], np.diff(b[1])[right]
    offsets = np.concatenate(([0], (n + m + 1).cumsum()))
    data = np.full(offsets[-1], 0x20, np.uint8)
    data[_within(offsets[:-1], n)] = a[0][_within(a[1][left], n)]
    data[_within(offsets[:-1] + n + 1, m)] = b[0][_within(b[1][right], m)]
    return data, offsets


def _distinct(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _strings(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """Piece by piece, the features of whole texts: runs of 1 to ``longest`` words joined by one space.

    Yields the number of a piece's first text, the words of each text, and for each length of a run the text and the
    distinct feature of each occurrence, and the bucket of each distinct feature. A null text has no words.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    whole, ends = _strings(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE_BYTES, side="right")) - 1)
        data = _LOWER[whole[ends[first] : ends[last]]]
        bounds = ends[first : last + 1] - ends[first]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IN_WORD[data]
        before, after = np.roll(inside, 1)[:-1], inside[1:].copy()
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges], after[edges - 1] = False, False
        inside = inside[:-1]
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        owner = np.searchsorted(bounds[1:], starts, side="right")
        offsets = np.concatenate(([0], (stops - starts).cumsum())).astype(np.int64)
        compact = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
        words, known = _distinct(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), compact))
        names = _strings(known)
        runs, run_names = words, names
        levels = [(owner, runs, crc_by_length(*names) % buckets)]
        at = np.arange(len(words))
        for length in range(2, longest + 1):
            keep = at + length - 1 < len(words)
            keep[keep] = owner[at[keep]] == owner[at[keep] + length - 1]
            at = at[keep]
            runs, pairs = _distinct(pa.array(runs[keep] * len(known) + words[at + length - 1]))
            left, right = np.divmod(pairs.to_numpy(), max(1, len(known)))
            run_names = _joined(run_names, left, names, right)
            levels.append((owner[at], runs, crc_by_length(*run_names) % buckets))
        yield first, np.bincount(owner, minlength=last - first), levels
        first = last


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row per bucket that it met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, levels in features(batch.column(0), longest, buckets):
                for _, runs, bucket in levels:
                    times = np.bincount(runs, minlength=len(bucket))
                    seen += np.bincount(bucket, weights=times, minlength=buckets).astype(np.int64)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an occurrence in each bucket speaks for the target, in thousandths of a natural logarithm, rounded down."""
    size = len(source)
    above = (target + 1.0) * float(source.sum() + size)
    below = (source + 1.0) * float(target.sum() + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row; the weight is the mean gain of its features, rounded down."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for first, words, levels in features(batch.column("text"), longest, len(gain)):
                here = slice(first, first + len(words))
                n_words[here] = words
                for owner, runs, bucket in levels:
                    n[here] += np.bincount(owner, minlength=len(words))
                    # Sums of whole numbers below 2^53 are exact in doubles.
                    total[here] += np.bincount(owner, weights=gain[bucket][runs], minlength=len(words)).astype(np.int64)
            out = [batch.column("doc_id"), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` for every row of ``docs(doc_id, text)``.

    Weights are ratios of hashed feature counts of ``target(text)`` and ``docs``; Gumbel noise from a hash of the id makes
    the highest scores a sample without replacement in proportion to them. Of the rows with ``min_words`` words, ``percent``
    percent (rounded down) are drawn, ties to the smaller id; the others have a null ``rank``. Null and empty texts have no
    features, weight 0, and are never drawn (unless ``min_words`` is 0). A null id counts as empty text in the hash and stands
    after all others; repeated rows are drawn one by one. Empty tables give an empty result, or weights against nothing.

    Two passes over the texts, which are hashed twice rather than stored; counts of ``buckets`` buckets pass through
    the driver, and one count per score (scores span some 100,000 whole numbers whatever the input). Only rows that
    may be drawn are sorted, in ranges.
    """
    importable(docs.sparkSession)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    weighed = weigh(docs, gain, longest)
    scored = checkpointed(
        weighed.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row"))
    )
    able = F.col("n_words") >= min_words
    levels = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).toArrow()
    above = np.cumsum(levels.column("n").to_numpy())
    drawn = int(above[-1]) * percent // 100 if len(above) else 0
    # The lowest score that is drawn; rows below it need no place in the order.
    least = levels.column("score")[int(np.searchsorted(above, drawn))].as_py() if drawn else None
    may = F.coalesce(able & (F.col("score") >= F.lit(least)), F.lit(False))
    placed = numbered(scored.where(may), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~may).select(*names, F.lit(None).cast("long").alias("rank"), "n_words")
    return placed.select(*names, rank.alias("rank"), "n_words").union(rest)


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns; a repeated id counts as drawn if one of its
    rows is, and rows without an id are left out."""
    chosen = checkpointed(resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct())
    return join_checked(docs, chosen, ["doc_id"], "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# DuckDB: words by regular expression, CRC-32 byte by byte from a table that a recursion makes.
_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SQL_RUNS = (
    "unnest(list_concat(words, list_transform(range(1, greatest(len(words), 1)), "
    "lambda i: words[i] || ' ' || words[i + 1]))) AS f"
)
SQL = {
    "op11_resampling": rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS a FROM bits WHERE k = 8
), d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents
), b AS (SELECT {_SQL_WORDS} AS words FROM benchmark
), df AS (SELECT doc_id, {_SQL_RUNS} FROM d
), bf AS (SELECT {_SQL_RUNS} FROM b
), h AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(f)) + 1),
           lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, a[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), crc
), s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})
           / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id
), c AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) AS n_words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_words >= {MIN_WORDS}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank, n_words::BIGINT AS n_words
FROM c LEFT JOIN r USING (doc_id)""",
}
