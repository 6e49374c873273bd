"""op13 against plain Python over every order, and on odd tables."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from cohortcheck.llm import audit
from tests.llm.test_operators import DOCS, ODD


def fails_of(rows):
    """The failed filters of each row of (doc_id, text, lang)."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(
            i is not None and i < doc_id and (t or "") == text for i, t, _ in rows
        )
        tests = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": copy,
        }
        out.append({name for name, failed in tests.items() if failed})
    return out


def brute(rows, good, toxic):
    fails, out = fails_of(rows), {}
    for part in {lang or "" for *_, lang in rows}:
        here = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                failing = sum(name in f for _, f in here)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == {name} for _, f in here),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[name])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_plain_python(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        words = random.choices([f"w{k}" for k in range(random.choice([30, 400]))], k=random.choice([0, 20, 150, 300]))
        if random.random() < 0.3:
            words = [w.upper() for w in words]
        if random.random() < 0.3:
            words.append("a|b")
        rows.append((i, " ".join(words), random.choice(["en", "de", None])))
    # A text with a third of all rows, null and repeated ids, and null texts, which are empty ones.
    rows += [(1000 + i, rows[7][1], "en") for i in range(150)]
    rows += [(None, rows[5][1], "de"), (None, rows[5][1], ""), (4, rows[4][1], "fr"), (2000, None, "en"), (2001, "", "en")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 1100, 2)] + [(2, 1, None), (3, None, 1), (None, 1, 1), (4, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = as_dict(audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    assert got == brute(rows, good, toxic)


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, t, lang) for i, t, lang, *_ in ODD]
    assert as_dict(audit.audit(odd, none)) == brute(rows, set(), set())
    assert audit.audit(odd.limit(0), none).count() == 0
    # Names of the operator's own columns on the input make no difference.
    clash = odd.withColumns({n: F.lit("x") for n in ("part", "first_id", "good", "filter", "digest")})
    assert as_dict(audit.audit(clash, none)) == brute(rows, set(), set())


def test_clean_parts_have_rows_too(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = as_dict(audit.audit(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")))
    assert len(got) == 600 and set(map(tuple, got.values())) == {(1, 0, 0, 0, 0, 0, 0)}


def test_other_filters(spark):
    """Any conditions over the measures make a chain; two filters have two orders."""
    docs = spark.createDataFrame([(i, "a b " * i, "en") for i in range(6)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_dict(audit.audit(docs, none, {"S": "n_words < 4", "L": "n_words > 2"}))
    assert set(got) == {("en", o, s) for o in ("SL", "LS") for s in (1, 2)}
    assert [got["en", "SL", 1][:2], got["en", "SL", 2][:2]] == [[4, 2], [0, 4]]
