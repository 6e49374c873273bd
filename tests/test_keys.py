"""Keys are read as cells are, plain ones without a pattern."""

from cohortcheck import normalize
from cohortcheck.functions import clean_text, number, parsing
from tests.helpers import LAYOUT, table

KEYS = [
    "0", "7", "-5", "+5", "007", "1.0", "1.5", ".5", "5.", "-0", "1e3", " 12", "12 ", "1\u00a0", "\u20033", "12\x01", "88888", " 99999",
    "888888", "X-3", "", " ", "NaN", "1d", "Infinity", "0x10", "9007199254740993", "9223372036854775807", "9223372036854775808",
    "-9223372036854775808", "UNK", "1,200", "١", None,
]


def test_keys_are_what_the_pattern_makes_of_them(spark):
    cells = spark.createDataFrame([(k,) for k in KEYS], "k string")
    got = cells.selectExpr("k", f"{parsing.key_number('k')} AS a", f"{number(clean_text('k'))} AS b").collect()
    assert [(r.k, r.a) for r in got] == [(r.k, r.b) for r in got]


def test_whole_keys_need_no_pattern(spark, monkeypatch):
    monkeypatch.setattr(parsing, "_NUMBER", "^no number$")
    rows = table(spark, {"subject_id": "12"}, {"subject_id": "88888"}, {"subject_id": "x"})
    assert [r[0] for r in normalize(rows, LAYOUT, drop_keyless=False).select("subject_id").collect()] == [12.0, None, None]
