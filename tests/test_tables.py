"""Reading, staging, sites, reshaping, profiles, report views and writing."""

from datetime import date

import pytest
from tests.helpers import CLEAN, LAYOUT, PACK, SETTINGS, table

from cohortcheck import Layout, normalize, validate
from cohortcheck.functions import contains
from cohortcheck.operators import explode_codes, missing_profile, to_long
from cohortcheck.packs import CLINICAL_NAMES, SHORT_NAMES, injectables
from cohortcheck.plans import for_export, report_filter, report_page, summarize
from cohortcheck.sources import choose_site, list_sites, read_cells, stage, write_result

BY_SITE = Layout(by=("site",))


@pytest.fixture
def by_site(spark):
    changes = [{"site": s, "subject_id": k, "sex_birth": x} for s, k, x in (
        ("north", "1", "9"), ("north", "1", "1"), ("south", "1", "8"), ("south", "2", None), ("west", "3", "1"),
    )]
    return table(spark, *changes)


def test_csv_cells_stay_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text("subject_id,vl_1_date,zip_code\n007,44230,01234\nNA,,\n")
    df = read_cells(spark, str(tmp_path / "in.csv"), "csv")
    assert set(dict(df.dtypes).values()) == {"string"}
    assert [tuple(r) for r in df.collect()] == [("007", "44230", "01234"), ("NA", None, None)]
    staged = stage(df, str(tmp_path / "staged"))
    assert staged.where("row_id IS NULL").count() == 0
    typed = normalize(staged, LAYOUT)
    assert [(r.subject_id, r.vl_1_date) for r in typed.collect()] == [(7.0, date(2021, 2, 3))]


def test_sites(by_site, spark, tmp_path):
    staged = stage(by_site, str(tmp_path / "staged"), by=("site",))
    assert [r.site for r in list_sites(staged).collect()] == ["north", "south", "west"]
    plan = choose_site(staged, "north")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(site" in plan
    every = validate(staged, PACK, SETTINGS, BY_SITE)
    single = []
    for site in ("north", "south", "west"):
        one = validate(choose_site(staged, site).drop("site"), PACK, SETTINGS, LAYOUT).report
        single += [(site, *r) for r in one.collect()]
    got = [(r.site, *[r[c] for c in r.asDict() if c != "site"]) for r in every.report.collect()]
    assert sorted(map(str, got)) == sorted(map(str, single))
    assert sum(r[2] == "V01" for r in got) == 2
    assert every.missing.where("site = 'south' AND column = 'sex_birth'").first().n_missing == 1


def test_write_result(by_site, spark, tmp_path):
    result = validate(by_site, PACK, SETTINGS, BY_SITE)
    for _ in range(2):  # writing the same day again replaces it
        write_result(result, str(tmp_path / "out"), date(2024, 7, 1))
    back = spark.read.parquet(str(tmp_path / "out/report"))
    assert back.count() == result.report.count()
    assert "short_message" not in back.columns
    assert (tmp_path / "out/report/site=north/run_date=2024-07-01").is_dir()
    one = validate(by_site.where("site = 'west'").drop("site"), PACK, SETTINGS, LAYOUT)
    write_result(one, str(tmp_path / "csv"), date(2024, 7, 1), site="west", fmt="csv")
    missing = spark.read.option("header", True).csv(str(tmp_path / "csv/missing"))
    assert missing.count() == one.missing.count()


def test_slots_to_long(spark):
    df = table(spark, {"shot10_date": "2022-01-01"}, {})
    long = to_long(normalize(df, LAYOUT), SHORT_NAMES.shots, ["row_id"])
    assert long.columns == ["row_id", "index", "date", "dose"]
    assert sorted({r["index"] for r in long.collect()}) == [1, 2, 3, 10]
    assert long.where("`index` = 10 AND row_id = 0").first().date == date(2022, 1, 1)
    assert long.count() == 8
    events = to_long(normalize(df, LAYOUT), SHORT_NAMES.events, ["row_id"])
    assert {(r.event, r["index"]) for r in events.collect()} == {(e, i) for e in ("counsel", "screen") for i in (1, 2)}
    none = to_long(df.select("row_id"), SHORT_NAMES.shots, ["row_id"])
    assert none.columns == long.columns and none.count() == 0


def test_slot_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, {}).write.parquet(path)
    long = to_long(normalize(spark.read.parquet(path), LAYOUT), SHORT_NAMES.viral_loads, ["subject_id"])
    plan = long._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "vl_1_date" in schema and "shot1_date" not in schema and "language" not in schema


def test_codes_explode(spark):
    df = table(spark, {"not_elig_1_reason": "1,, 2", "disinterest_reason_1": None, "discontinued_reason": None})
    got = explode_codes(normalize(df, LAYOUT), contains("reason"), ["row_id"]).collect()
    assert [(r.column, r.position, r.code) for r in got] == [
        ("not_elig_1_reason", 0, "1"), ("not_elig_1_reason", 1, ""), ("not_elig_1_reason", 2, "2"),
    ]


def test_missing_profile(spark):
    df = normalize(table(spark, {"age": "x"}, {"age": "N/A", "zip_code": ""}, {}), LAYOUT)
    got = {r.column: (r.n_missing, r.total_count) for r in missing_profile(df, ["age", "zip_code"]).collect()}
    assert got == {"age": (2, 3), "zip_code": (1, 3)}


def test_optional_columns_may_be_absent_and_others_not(spark):
    df = table(spark, {}).drop("gender_id", "immigration_status_undoc")
    result = validate(df, PACK, SETTINGS, LAYOUT)
    assert result.report.count() == 0
    assert result.missing.where("column = 'immigration_status_undoc'").first().n_missing == 1
    with pytest.raises(ValueError, match="language"):
        validate(df.drop("language"), PACK, SETTINGS, LAYOUT)


def test_report_views(spark):
    df = table(spark, {"sex_birth": "9"}, {"sex_birth": "8", "shot2_date": "2021-06-01"}, {})
    report = validate(df, PACK, SETTINGS, LAYOUT).report
    assert report.columns == [
        "subject_id", "rule_id", "description", "column1", "value1", "column2", "value2", "short_message",
        "date_difference",
    ]
    counts = [(r.short_message, r.error_count) for r in summarize(report).collect()]
    assert counts[0] == ("Sex at birth is not an allowed code", 2)
    assert sum(n for _, n in counts) == report.count() == 4
    assert [r.date_difference for r in report_filter(report, rule_id="V30").collect()] == ["0"]
    assert report_filter(report, column2=None).count() == 2
    order = ["rule_id", "subject_id"]
    pages = [report_page(report, order, number=n, size=3).collect() for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [3, 1, 0]
    assert "short_message" not in for_export(report).columns


def test_clinical_names(spark):
    renames = {"vl_pre_result": "hiv_vl_pre_icab_result"}
    for name in CLEAN:
        if name.startswith("vl_") and name not in renames:
            renames[name] = f"hiv_{name}"
        elif name.startswith(("shot", "counsel", "screen", "rx", "discontinued", "not_elig", "disinterest")):
            renames[name] = f"icab_rpv_{name}"
    bad = {"shot2_date": "2021-06-01", "counsel_ever": "0", "not_elig_1_reason": "99", "vl_pre_result": None}
    df = table(spark, bad).withColumnsRenamed(renames)
    report = validate(df, injectables(CLINICAL_NAMES), SETTINGS, LAYOUT).report
    assert {(r.rule_id, r.column1) for r in report.collect()} == {
        ("V24", "icab_rpv_not_elig_1_reason"), ("V30", "icab_rpv_shot1_date"), ("V35", "icab_rpv_shot1_date"),
        ("V33", "hiv_vl_pre_icab_result"), ("V38", "icab_rpv_counsel_ever"),
    }


def test_no_shuffle_when_every_subject_has_one_row(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, {}, {"sex_birth": "9"}, {"shot2_date": "2021-06-01"}).write.parquet(path)
    report = validate(spark.read.parquet(path), PACK, SETTINGS, LAYOUT).report
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BatchEvalPython" not in plan
    assert report.count() == 3
