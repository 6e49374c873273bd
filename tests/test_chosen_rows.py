"""Rows are told apart by their key before their cells are looked at."""

import pytest

from cohortcheck.operators.joins import chosen
from cohortcheck.plans.validation import use_checkpoints


@pytest.fixture
def per_key(spark):
    use_checkpoints(spark)
    return spark.createDataFrame([("a", 0.0, 2), ("b", 3.0, 2)], "site string, k double, _n_rows long").checkpoint()


def _rows(spark, bad: str):
    rows = spark.createDataFrame(
        [("a", -0.0), ("a", 3.0), ("b", 3.0), ("b", None), ("", 7.0)], "site string, k double"
    ).checkpoint()
    # As when a cell is parsed: costs, or here fails, wherever it is computed.
    return rows.selectExpr("site", "k + 0 AS k", f"CASE WHEN {bad} THEN raise_error('looked at') ELSE 'x' END AS cell")


@pytest.mark.parametrize("marks", [False, True])
def test_rows_left_out_are_not_parsed(spark, per_key, marks):
    inside = "(site = 'a' AND k = 0) OR (site = 'b' AND k <=> 3D)"
    got = chosen(_rows(spark, f"NOT ({inside})"), per_key, ["site", "k"], marks).collect()
    assert sorted((r.site, r.k) for r in got) == [("a", 0.0), ("b", 3.0)]
    got = chosen(_rows(spark, inside), per_key, ["site", "k"], marks, others=True).collect()
    assert sorted((r.site, str(r.k)) for r in got) == [("", "7.0"), ("a", "3.0"), ("b", "None")]


@pytest.mark.parametrize("marks", [False, True])
def test_every_row_goes_one_way(spark, marks):
    use_checkpoints(spark)
    rows = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS k")
    per_key = rows.where("k % 7 = 0").checkpoint()
    inside = {r.k for r in chosen(rows, per_key, ["k"], marks).collect()}
    outside = {r.k for r in chosen(rows, per_key, ["k"], marks, others=True).collect()}
    assert not inside & outside and len(inside) + len(outside) == 5000
    assert {k for k in range(5000) if k % 7 == 0} <= inside
    assert marks or len(inside) == 715
