"""Selectors, text cleaning, dates and numbers."""

from datetime import date

import pytest

from cohortcheck.functions import (
    any_of,
    clean_text,
    column,
    contains,
    everything,
    mixed_date,
    number,
    number_text,
)

COLUMNS = ["subject", "race_white", "Race_Other", "race_specify", "vl_1_result", "vl_1_date"]


def test_selectors_combine_and_ignore_case():
    assert contains("RACE")(COLUMNS) == ["race_white", "Race_Other", "race_specify"]
    assert (contains("race") & ~contains("other"))(COLUMNS) == ["race_white", "race_specify"]
    assert (contains("date") | any_of("subject", "absent"))(COLUMNS) == ["subject", "vl_1_date"]
    assert everything()(COLUMNS) == COLUMNS
    assert contains("nothing")(COLUMNS) == []


def test_required_column_must_exist():
    assert column("subject")(COLUMNS) == ["subject"]
    with pytest.raises(ValueError, match="absent"):
        (column("absent") | contains("race"))(COLUMNS)


def parsed(spark, make, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").selectExpr(f"{make('c')} AS v").collect()]


def test_null_tokens_and_trimming(spark):
    cells = ["NA", "UNK", "Unk", "N/A", "88888", "888888", "99999", "999999", "", " \t", None]
    assert parsed(spark, clean_text, cells) == [None] * len(cells)
    assert parsed(spark, clean_text, ["unk", "na", " 1 ", " NA ", "8888"]) == ["unk", "na", "1", None, "8888"]


@pytest.mark.parametrize("cell, expected", [
    ("2021-02-03", date(2021, 2, 3)),
    ("2021-2-3", date(2021, 2, 3)),
    ("2021-02-03 10:00", date(2021, 2, 3)),
    ("2/3/2021", date(2021, 2, 3)),
    ("02/03/2021 10:00", date(2021, 2, 3)),
    ("02/03/21", date(21, 2, 3)),
    ("21-02-03", date(21, 2, 3)),
    ("44230", date(2021, 2, 3)),
    ("44230.75", date(2021, 2, 3)),
    ("4.423e4", date(2021, 2, 3)),
    ("2021/02/03", None),
    ("2021-02-03 1/2", None),
    ("2/30/2021", None),
    ("13/1/2021", None),
    ("-5", None),
    ("1d", None),
    ("NaN", None),
    ("soon", None),
    ("-2021-01-1", None),
    (None, None),
])
def test_mixed_dates(spark, cell, expected):
    assert parsed(spark, mixed_date, [cell]) == [expected]


def test_numbers(spark):
    cells = ["12", "+1.5", ".5", "1e3", "-0", "1d", "NaN", "Infinity", "x", "1 2", None]
    assert parsed(spark, number, cells) == [12.0, 1.5, 0.5, 1000.0, 0.0, None, None, None, None, None, None]


def test_number_text(spark):
    df = spark.createDataFrame([(30.0,), (25.5,), (None,), (-7.0,)], "v double")
    assert [r[0] for r in df.selectExpr(f"{number_text('v')} AS t").collect()] == ["30", "25.5", None, "-7"]
