"""Names in other case, slot numbers with zeros, odd white space and trailing text."""

from datetime import date

import pytest

from cohortcheck import Layout, Settings, normalize, violations
from cohortcheck.functions.parsing import mixed_date, number_text, trimmed
from cohortcheck.operators import clean_cells
from cohortcheck.packs import injectables

SETTINGS = Settings(as_of=date(2024, 6, 30))
LAYOUT = Layout(row="copy")


def found(spark, row, rule):
    columns = ", ".join(f"`{c}` {'long' if c == 'copy' else 'string'}" for c in row)
    typed = normalize(spark.createDataFrame([tuple(row.values())], columns), LAYOUT, drop_keyless=False)
    return [(r["column1"], r["value1"]) for r in violations(typed, injectables().only(rule), SETTINGS, LAYOUT).collect()]


def test_slots_of_both_spellings_are_looked_at(spark):
    row = {"subject_id": "1", "copy": 0, "shot1_date": "2021-03-01", "shot01_date": "2030-01-01", "shot1_dose": "1", "shot01_dose": "1"}
    assert found(spark, row, "V36") == [("shot01_date", "2030-01-01")]
    row |= {"shot1_date": "2030-02-02", "shot01_date": "2021-03-01"}
    assert found(spark, row, "V36") == [("shot1_date", "2030-02-02")]


def test_case_of_names(spark):
    row = {"subject_id": "1", "copy": 0, "Shot1_Date": "2030-01-01", "Shot1_Dose": "1"}
    assert found(spark, row, "V36") == [("Shot1_Date", "2030-01-01")]
    typed = normalize(spark.createDataFrame([("1", 0, "2")], "subject_id string, copy long, Gender_ID string"), LAYOUT)
    assert typed.columns.count("Gender_ID") == 1 and "gender_id" not in typed.columns


def test_names_that_differ_by_case_are_an_error(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="differ only by case"):
            clean_cells(spark.createDataFrame([("1", 0, "a", "b")], "subject_id string, copy long, rx string, RX string"), LAYOUT)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.parametrize("tail", ["", "x", "ab", " 10:30", "T00:00:00", " and more text"])
@pytest.mark.parametrize("cell", ["2021-02-03", "2021-2-3", "2021-02-3", "2/3/2021"])
def test_text_after_a_date_does_not_matter(spark, cell, tail):
    assert spark.sql(f"SELECT {mixed_date(f"'{cell}{tail}'")} AS d").first()["d"] == date(2021, 2, 3)


def test_white_space_of_unicode(spark):
    blanks = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2003\u2028\u202f\u3000"
    df = spark.createDataFrame([(f"{blanks}a b{blanks}",)], "c string").selectExpr(f"{trimmed('c')} AS c")
    assert df.first()["c"] == "a b"


def test_whole_numbers_look_alike(spark):
    got = spark.sql(f"SELECT {number_text('1e15D')} a, {number_text('12D')} b, {number_text('1.5D')} c").first()
    assert tuple(got) == ("1000000000000000", "12", "1.5")
