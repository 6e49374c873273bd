"""Runs that replace what an earlier run of the day left, and only that."""

from collections import Counter
from datetime import date

import pytest
from py4j.protocol import Py4JJavaError

from cohortcheck import Layout, validate
from cohortcheck.sources import published, publish, published_runs, read_published, remove_replaced, write_result
from tests.helpers import LAYOUT, PACK, SETTINGS, table

BY_SITE = Layout(by=("site",))
DAY, NEXT = date(2024, 7, 1), date(2024, 7, 2)
FEW = PACK.only("V01", "V02", "V07")


def run(spark, **codes):
    """A run over the named sites, each with a subject whose sex at birth has the given code (9 is a finding)."""
    changes = [{"site": s.replace("_", " "), "subject_id": str(i), "sex_birth": c} for i, (s, c) in enumerate(codes.items())]
    return validate(table(spark, *changes), FEW, SETTINGS, BY_SITE)


def found(df):
    return Counter((r.site, str(r.run_date), r.value1) for r in df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_clean_run_leaves_nothing_of_an_earlier_one(spark, tmp_path, fmt):
    path = str(tmp_path / "out")

    def back(name="report"):
        return spark.read.option("header", True).format(fmt).load(f"{path}/{name}")

    write_result(run(spark, a="9", b="9", c="9"), path, DAY, fmt=fmt)
    write_result(run(spark, a="9"), path, NEXT, fmt=fmt)
    write_result(run(spark, a="1", b="8"), path, DAY, fmt=fmt)
    assert found(back()) == Counter([("a", "2024-07-02", "9"), ("b", "2024-07-01", "8"), ("c", "2024-07-01", "9")])
    missing = Counter((r.site, str(r.run_date)) for r in back("missing").select("site", "run_date").distinct().collect())
    assert missing == Counter([("a", "2024-07-01"), ("a", "2024-07-02"), ("b", "2024-07-01"), ("c", "2024-07-01")])
    assert [p.name for p in (tmp_path / "out").iterdir() if "staged" in p.name] == []


def test_sites_that_sent_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_result(run(spark, a="9", **{"b_x": "9"}), path, DAY)
    write_result(run(spark, a="9"), path, DAY, sites=["b x"])
    assert {s for s, *_ in found(spark.read.parquet(f"{path}/report"))} == {"a"}


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_result(run(spark, a="9"), path, DAY)
    broken = run(spark, a="1")
    broken = type(broken)(broken.report, broken.missing.selectExpr("*", "raise_error('no') AS e"), broken.sites)
    with pytest.raises(Exception, match="no"):
        write_result(broken, path, DAY)
    assert found(spark.read.parquet(f"{path}/report")) == Counter([("a", "2024-07-01", "9")])


def test_one_table_without_a_site_column(spark, tmp_path):
    path = str(tmp_path / "out")
    for code in ("9", "1"):
        one = validate(table(spark, {"sex_birth": code}), FEW, SETTINGS, LAYOUT)
        write_result(one, path, DAY, site="west")
    write_result(one, path, DAY, site="east")
    assert not (tmp_path / "out/report/site=west/run_date=2024-07-01").exists()
    assert (tmp_path / "out/missing/site=east/run_date=2024-07-01").exists()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_publish(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    first = publish(run(spark, a="9", b="9", c="9"), path, DAY, fmt=fmt)
    publish(run(spark, a="9"), path, NEXT, fmt=fmt)
    assert found(read_published(spark, path, "report", DAY)) == Counter((s, "2024-07-01", "9") for s in "abc")
    # Site a is clean now, site b has another finding, site c sent no row any more, and d is new and clean.
    publish(run(spark, a="1", b="8", d="1"), path, DAY, fmt=fmt, sites=["c"])
    report, missing = (read_published(spark, path, t) for t in ("report", "missing"))
    assert found(report) == Counter([("a", "2024-07-02", "9"), ("b", "2024-07-01", "8")])
    days = {(r.site, r.run_date) for r in missing.select("site", "run_date").distinct().collect()}
    assert days == {("a", "2024-07-01"), ("a", "2024-07-02"), ("b", "2024-07-01"), ("d", "2024-07-01")}
    assert dict(report.dtypes)["subject_id"] == "double" and dict(missing.dtypes)["n_missing"] == "bigint"
    assert published_runs(spark, path).count() == 5
    # Nothing counts of the first run any more.
    assert remove_replaced(spark, path) == [first]
    assert found(read_published(spark, path, "report")) == found(report)
    assert (tmp_path / f"out/report/run={first}").exists() is False


def test_both_tables_change_with_the_commit(spark, tmp_path, monkeypatch):
    """A run that stops before its last step is not seen, in neither table; nor is one that comes second."""
    path = str(tmp_path / "out")
    publish(run(spark, a="9"), path, DAY)
    before = [sorted(map(str, read_published(spark, path, t).collect())) for t in published.TABLES]

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(published.files, "write_new", stop)
        with pytest.raises(KeyboardInterrupt):
            publish(run(spark, a="8"), path, DAY)
    assert [sorted(map(str, read_published(spark, path, t).collect())) for t in published.TABLES] == before
    with monkeypatch.context() as patch:
        # As if this run had looked before the other one was done.
        patch.setattr(published, "_latest", lambda *_: (None, 0))
        with pytest.raises(Py4JJavaError, match="already exists"):
            publish(run(spark, a="8"), path, DAY)
    assert [sorted(map(str, read_published(spark, path, t).collect())) for t in published.TABLES] == before


def test_nothing_published(spark, tmp_path):
    assert published_runs(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(ValueError, match="nothing was published"):
        read_published(spark, str(tmp_path / "out"), "report")
    with pytest.raises(ValueError, match="name of its site"):
        publish(validate(table(spark, {}), FEW, SETTINGS, LAYOUT), str(tmp_path / "out"), DAY)


def test_sites_without_a_name(spark, tmp_path):
    df = table(spark, {"site": None, "sex_birth": "9"}, {"site": "a", "sex_birth": "9"})
    for code in (None, 1):
        result = validate(df if code is None else table(spark, {"site": None}), FEW, SETTINGS, BY_SITE)
        publish(result, str(tmp_path / "out"), DAY)
    assert found(read_published(spark, str(tmp_path / "out"), "report")) == Counter([("a", "2024-07-01", "9")])


def test_only_folders_of_valid_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "out")
    for code in ("9", "8", "7"):
        last = publish(run(spark, a=code), path, DAY)
    plan = read_published(spark, path, "report")._jdf.queryExecution().executedPlan().toString()
    assert last in plan.split("PartitionFilters: ")[1].split("]")[0]
