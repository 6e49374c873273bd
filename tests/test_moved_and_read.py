"""What a run over many rows need not do: move the texts of rules, look at events of other kinds, ask Python for no sites."""

from datetime import date

from cohortcheck import Layout, normalize, validate
from cohortcheck.packs import SHORT_NAMES
from cohortcheck.packs.injectables import _Course
from cohortcheck.plans.contexts import RowContext
from cohortcheck.sources.writers import checked_sites, dated, spread
from tests.helpers import LAYOUT, PACK, SETTINGS, table


def test_texts_of_rules_are_not_moved(spark):
    by_site = Layout(row=LAYOUT.row, by=("site",))
    rows = table(spark, {"shot2_date": None}, {"subject_id": "x"}).selectExpr("'a' AS site", "*")
    result = validate(rows, PACK, SETTINGS, by_site)
    day = date(2024, 1, 1)
    moved = spread(result, "report", day, None, ["site", "run_date"])
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    # The texts are the other side of the join above; lines of this side begin with its branch.
    assert "description" in above and not any("description" in line for line in below.splitlines() if line.startswith("   :"))
    assert moved.schema.names == dated(result, "report", day, None).schema.names
    assert sorted(map(str, moved.collect())) == sorted(map(str, dated(result, "report", day, None).collect()))


def test_questions_about_events_go_through_one_kind(spark):
    rows = normalize(table(spark, {"counsel_1_date": "2021-01-05", "screen_1_date": "2021-01-06"}), LAYOUT)
    ctx = RowContext(dict(rows.dtypes), LAYOUT, SETTINGS)
    name = _Course(ctx, SHORT_NAMES).exists("screen", "_e.date IS NOT NULL").split("(")[1].split(",")[0]
    assert {e.event for e in ctx.checked(rows).select(name).first()[0]} == {"screen"}


def test_sites_that_nobody_names_start_no_python(spark):
    by_site = Layout(row=LAYOUT.row, by=("site",))
    rows = table(spark, {"subject_id": "1"}, {"subject_id": "2"}).selectExpr("concat('s', subject_id) AS site", "*")
    result = validate(rows, PACK.only("V07"), SETTINGS, by_site)
    day = date(2024, 1, 1)

    def scans(sites):
        found = checked_sites(result, day, None, sites)
        return sorted(r.site for r in found.collect()), found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")

    alone, named = scans(None), scans(["s2", "s3"])
    assert alone[0] == ["s1", "s2"] and named[0] == ["s1", "s2", "s3"] and alone[1] == named[1] - 1
