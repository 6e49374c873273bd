"""Searching a report, and pages of one that was written in order."""

from datetime import date

import pytest

from cohortcheck.plans import Between, report_search, rules_that_fit
from cohortcheck.plans.search import read_wanted
from cohortcheck.sources import read_page, write_ordered
from tests.helpers import PACK

SCHEMA = "subject_id double, rule_id string, value1 string, n int, day date"
ROWS = [
    (1.0, "V30", "2021-03-01", 1, date(2021, 3, 1)),
    (2.0, "V31", "9", 2, date(2021, 4, 1)),
    (3.0, "V30", "2021-05-01", None, None),
    (None, "V02", None, 4, date(2022, 1, 1)),
    (10.0, "v30x", "2021-3", 5, date(2023, 1, 1)),
    (20.5, "V34", "10", 6, date(2024, 1, 1)),
]


@pytest.mark.parametrize("wanted, ids", [
    ({"rule_id": "v30"}, [1.0, 3.0, 10.0]),
    ({"rule_id": ["V30", "V02"]}, [None, 1.0, 3.0]),
    ({"subject_id": "2 ... 10"}, [2.0, 3.0, 10.0]),
    ({"subject_id": " ... 2"}, [1.0, 2.0]),
    ({"subject_id": Between(low=10)}, [10.0, 20.5]),
    ({"subject_id": [1, 20.5, None]}, [None, 1.0, 20.5]),
    ({"subject_id": 3}, [3.0]),
    ({"value1": "2021-03-01 ... 2021-12-31"}, [1.0, 3.0]),
    ({"value1": "5 ... 10"}, [2.0, 20.5]),
    ({"value1": None}, [None]),
    ({"value1": [None, "9"]}, [None, 2.0]),
    ({"value1": "2021"}, [1.0, 3.0, 10.0]),
    ({"n": "2 ... 5"}, [None, 2.0, 10.0]),
    ({"day": "2021-04-01 ... 2023-01-01"}, [None, 2.0, 10.0]),
    ({"rule_id": "V3", "subject_id": "... 2", "value1": "2021-01-01 ... "}, [1.0]),
    ({"rule_id": "%"}, []),
    ({"rule_id": " ... "}, []),
])
def test_search(spark, wanted, ids):
    got = [r.subject_id for r in report_search(spark.createDataFrame(ROWS, SCHEMA), **wanted).collect()]
    assert sorted(got, key=lambda v: (v is not None, v)) == ids


def test_what_boxes_say():
    assert read_wanted("10 ... 20") == Between(10.0, 20.0)
    assert read_wanted("2021-03-01 ...") == Between(date(2021, 3, 1), None)
    assert read_wanted("a ... b") == "a ... b" and read_wanted("...") == "..." and read_wanted(["1 ... 2"]) == ["1 ... 2"]


def test_unknown_columns(spark):
    with pytest.raises(ValueError, match="no such column.*rule"):
        report_search(spark.createDataFrame(ROWS, SCHEMA), rule="V30")
    with pytest.raises(ValueError, match="not a text of a rule: column1"):
        rules_that_fit(PACK, column1="shot")


def test_search_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "r"))
    report = spark.read.parquet(str(tmp_path / "r"))
    found = report_search(report, rule_id=["V30", "V34"], subject_id="2 ... 10", value1="2021-03-01 ... 2021-12-31", day="2020-01-01 ...")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for part in ("In(rule_id, [V30,V34])", "GreaterThanOrEqual(subject_id,2.0)", "LessThanOrEqual(subject_id,10.0)",
                 "GreaterThanOrEqual(value1,2021-03-01)", "LessThanOrEqual(value1,2021-12-31)", "GreaterThanOrEqual(day,2020-01-01)"):
        assert part in pushed


def test_rules_that_cannot_show_are_not_checked():
    assert [r.rule_id for r in rules_that_fit(PACK, rule_id=["V34", "V35"], short_message="LATE").rules] == ["V34"]
    assert all("njection" in r.description for r in rules_that_fit(PACK, description="injection").rules)


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered") / "t")
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN id % 13 END AS `a b`", "CAST(id * 7919 % 5003 AS STRING) AS c")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(rows, path, ["a b", "c"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, rows


@pytest.mark.parametrize("size", [1, 7, 640, 5000, 9999])
def test_pages_are_those_of_the_sorted_report(spark, ordered, size):
    path, rows = ordered
    every = rows.orderBy("`a b`", "c").collect()
    last = -(-len(every) // size)
    for number in sorted({1, 2, max(1, last // 2), last, last + 1}):
        page = read_page(spark, path, number, size)
        assert page.columns == rows.columns
        assert page.collect() == every[(number - 1) * size : number * size]


def test_a_deep_page_reads_what_the_first_reads(spark, ordered):
    path, _ = ordered
    folders = []
    for number in (1, 480):
        page = read_page(spark, path, number, 10)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(_at" in plan
        folders.append({f.split("_range=")[1].split("/")[0] for f in page.inputFiles()})
        assert page.count() == 10
        filters = plan.split("PartitionFilters: ")[1].split("]")[0]
        assert filters.count("_range") >= 1


def test_pages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    write_ordered(empty, str(tmp_path / "t"), ["rule_id"])
    assert read_page(spark, str(tmp_path / "t")).columns == empty.columns
    assert read_page(spark, str(tmp_path / "t"), 3).count() == 0
    with pytest.raises(ValueError, match="from 1"):
        read_page(spark, str(tmp_path / "t"), 0)
