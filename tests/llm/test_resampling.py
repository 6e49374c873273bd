"""op11 against plain Python: CRCs, features, weights and the draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortcheck.llm import resampling
from tests.llm.test_operators import DOCS, ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [("word1 word2 Word3 über",), ("word2 word3",), (None,), ("",)]


def brute_features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, runs


def brute(rows, target, percent, seed, min_words, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in brute_features(text, longest)[1])
    t = Counter(bucket(f) for (text,) in target for f in brute_features(text, longest)[1])
    size_s, size_t = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * size_s / ((s[b] + 1) * size_t))) for b in s}
    out = []
    for doc_id, text in rows:
        words, runs = brute_features(text, longest)
        weight = sum(gain[bucket(f)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(runs), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("options", [(25, 7, 20, 2, 10_000), (100, 3, 0, 1, 7), (60, 7, 2, 3, 100), (0, 7, 20, 2, 10)])
def test_against_plain_python(spark, options):
    random.seed(5)
    vocabulary = ["a", "B9", "über", "x" * 300, "it's", "naïve—word", "日本", "z" * 7, "Y2K", "é"]
    rows = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 60)))) for i in range(120)]
    rows += [(500, rows[3][1]), (None, rows[4][1]), (7, None), (8, ""), (9, "--- ...\n"), (11, "\x7fA\x00b\U0001f600c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame(TARGET, "text string"), *options)
    assert Counter(map(tuple, got.collect())) == brute(rows, TARGET, *options)


def test_odd_rows(spark):
    odd, target = spark.createDataFrame(ODD, DOCS), spark.createDataFrame(TARGET, "text string")
    got = resampling.resample(odd, target).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in ODD)
    # Six rows have 20 words or more; a repeated row is drawn by itself.
    assert [r["rank"] for r in ranked] == [1] and ranked[0]["n_features"] > 0
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert {r["weight"] for r in resampling.resample(odd, target.limit(0)).collect() if r["n_features"] == 0} == {0}
    drawn = resampling.draw(odd, target, percent=50)
    assert drawn.columns == odd.columns and drawn.count() >= 3 and drawn.where("doc_id IS NULL").count() == 0


def test_crc_by_length():
    random.seed(1)
    strings = [random.randbytes(random.choice([0, 1, 2, 9, 255, 256, 257, 1000])) for _ in range(400)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    assert resampling.crc_by_length(data, offsets).tolist() == [zlib.crc32(s) for s in strings]


def test_features_do_not_depend_on_pieces(monkeypatch):
    """Words never join across texts, wherever a piece ends; sliced and null columns are read right."""
    texts = ["one two", "", None, "three", "four five six", "x", "-", "seven"] * 3
    column = pa.array(["skipped", *texts])[1:]
    for size in (1, 9, 1 << 20):
        monkeypatch.setattr(resampling, "PIECE_BYTES", size)
        total = 0
        for first, words, levels in resampling.features(column, 2, 1000):
            for at, n in enumerate(words):
                assert n == len((texts[first + at] or "").replace("-", "").split())
            for owner, runs, bucket in levels:
                found = Counter(zip((owner + first).tolist(), bucket[runs].tolist()))
                total += sum(found.values())
                length = 1 if levels[0][1] is runs else 2
                for doc in set(owner + first):
                    words_here, _ = brute_features(texts[doc], 1)
                    grams = [" ".join(words_here[i : i + length]) for i in range(len(words_here) - length + 1)]
                    assert Counter(b for d, b in found.elements() if d == doc) == Counter(
                        zlib.crc32(g.encode()) % 1000 for g in grams
                    )
        assert total == sum(len(brute_features(t, 2)[1]) for t in texts)


def test_few_scores_pass_the_driver(spark):
    """A thousand rows with the same text and hot bucket: ranks stay gapless and follow the scores."""
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('same words here ', 10) AS text")
    got = resampling.resample(df, spark.createDataFrame(TARGET, "text string")).where("rank IS NOT NULL").collect()
    ordered = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in ordered] == list(range(1, 251))
