"""The cohort is staged by tasks of a bounded number of orders."""

import shutil
from collections import Counter

import pytest

from cohort_queries import catalogue
from cohort_queries import cohort as cohorts

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("by", [(), ("site",)])
def test_staging_tasks_are_bounded(spark, tmp_path, monkeypatch, by):
    shutil.copy(f"{SF_DIR}/orders.parquet", tmp_path)
    monkeypatch.setattr(cohorts, "ORDERS_PER_TASK", 100, raising=False)
    table = catalogue._staged(spark, str(tmp_path), by)
    written = [f.rsplit("/", 1)[1].split("-")[1] for f in table.inputFiles()]
    assert len(set(written)) == 15  # of 1,500 orders
    want = cohorts.cohort(spark, SF_DIR).selectExpr("concat('site-', k % 3) AS site", "* EXCEPT (k)")
    want = want.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in table.columns])
    assert Counter(map(tuple, table.collect())) == Counter(map(tuple, want.collect()))
