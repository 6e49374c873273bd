"""Slots whose key is no whole number, and tables with many slots."""

from datetime import date

import pytest

from cohortcheck import normalize, violations
from cohortcheck.operators import Slot, SlotFamily, to_long
from cohortcheck.operators.reshape import key_number
from cohortcheck.packs import CLINICAL_NAMES, SHORT_NAMES, injectables
from tests.helpers import LAYOUT, PACK, SETTINGS, table


def found(spark, pack, row, *rules):
    schema = ", ".join(f"`{c}` {'long' if c == 'row_id' else 'string'}" for c in row)
    typed = normalize(spark.createDataFrame([tuple(row.values())], schema), LAYOUT, drop_keyless=False)
    return [(r.column1, r.value1, r.column2, r.value2) for r in violations(typed, pack.only(*rules), SETTINGS, LAYOUT).collect()]


@pytest.mark.parametrize("key, number", [
    ("1", 1), ("01", 1), ("1.5", 1.5), ("2.0", 2), ("1e1", 10), ("-1", -1), (".5", 0.5), ("baseline", None), ("", None),
    ("1 ", None), ("1e999", None), ("nan", None), ("2b", None),
])
def test_numbers_of_keys(key, number):
    assert key_number(key) == number


def test_order_of_keys():
    names = ["vl_week 4_date", "vl_2_date", "vl_1.5_date", "vl_baseline_date", "vl_10_date", "vl_1_date", "vl_01_date", "vl__date"]
    slots = SHORT_NAMES.viral_loads.slots(names)
    assert [s.key for s in slots] == ["1", "01", "1.5", "2", "10", "week 4", "baseline", ""]
    assert [s.index for s in slots] == [1, 1, 1.5, 2, 10, None, None, None]


def test_what_is_no_slot():
    clinical = CLINICAL_NAMES.viral_loads
    names = ["hiv_vl_pre_icab_result", "hiv_vl_dx_date", "hiv_vl_at_DX_result", "hiv_vl_3_date", "hiv_vl_pre_date", "hiv_vl_dates"]
    assert [s.key for s in clinical.slots(names)] == ["3", "pre"]
    assert [s.key for s in SHORT_NAMES.viral_loads.slots(["vl_pre_result", "vl_prenatal_result"])] == ["prenatal"]
    # Injections and events are numbered.
    assert SHORT_NAMES.shots.slots(["shotx_date", "shot1.5_date", "shot2_date"]) == [Slot("2", {"date": "shot2_date"})]


def test_a_baseline_in_the_future_is_reported(spark):
    row = {"subject_id": "1", "row_id": 0, "vl_baseline_date": "2030-01-01", "vl_Baseline_result": None, "vl_1_date": "2021-01-01"}
    assert found(spark, PACK, row, "V29") == [("vl_baseline_date", "2030-01-01", None, None)]
    assert sorted(found(spark, PACK, row, "V28")) == [("vl_1_result", None, None, None), ("vl_Baseline_result", None, None, None)]


def test_rules_follow_the_order_of_keys(spark):
    """Listed as 2, baseline, 1.5, 1 in the table, compared as 1, 1.5, 2, baseline."""
    row = {"subject_id": "1", "row_id": 0, "vl_2_date": "2021-02-01", "vl_baseline_date": "2021-01-01",
           "vl_1.5_date": "2021-03-01", "vl_1_date": "2021-04-01"}
    assert sorted(found(spark, PACK, row, "V27")) == [
        ("vl_1.5_date", "2021-03-01", "vl_2_date", "2021-02-01"),
        ("vl_1_date", "2021-04-01", "vl_1.5_date", "2021-03-01"),
        ("vl_2_date", "2021-02-01", "vl_baseline_date", "2021-01-01"),
    ]


def test_repeated_subjects_with_such_keys(spark):
    df = table(spark, *[{"subject_id": "5", "vl_1.5_date": d, "vl_baseline_date": d} for d in ("2021-03-01", "2021-02-01")])
    typed = normalize(df.drop("vl_2_date", "vl_2_result"), LAYOUT, drop_keyless=False)
    got = violations(typed, PACK.only("V27"), SETTINGS, LAYOUT).collect()
    # In slot order, then by row: 1 (twice), 1.5 (twice), baseline (twice).
    assert sorted((r.row_id, r.column1, r.column2) for r in got) == [
        (1, "vl_1.5_date", "vl_1.5_date"), (1, "vl_baseline_date", "vl_baseline_date"),
    ]


def test_long_form(spark):
    df = spark.createDataFrame([("2021-01-01", "2021-01-02", "7")], "`vl_x_date` string, `vl_1.5_date` string, `vl_2_result` string")
    long = to_long(normalize_dates(df), SHORT_NAMES.viral_loads, [], keys=True)
    assert dict(long.dtypes)["index"] == "double"
    assert [tuple(r) for r in long.collect()] == [
        (1.5, "1.5", date(2021, 1, 2), None), (2.0, "2", None, "7"), (None, "x", date(2021, 1, 1), None),
    ]
    whole = to_long(normalize_dates(df.drop("vl_1.5_date")), SHORT_NAMES.viral_loads, [])
    assert dict(whole.dtypes)["index"] == "int" and [r["index"] for r in whole.collect()] == [2, None]
    none = to_long(df.select("vl_x_date").toDF("other"), SlotFamily("vl_{index}_{field}", {"date": "date"}), [], keys=True)
    assert none.columns == ["index", "slot", "date"]


def normalize_dates(df):
    return df.selectExpr(*[f"CAST(`{c}` AS DATE) AS `{c}`" if "date" in c else f"`{c}`" for c in df.columns])


def test_the_plan_of_a_rule_does_not_grow_with_slots(spark):
    from cohortcheck.plans.contexts import RowContext, SubjectContext

    def size(kind, slots):
        names = [f"{f}{i}_{p}" for i in range(1, slots + 1) for f, p in (
            ("vl_", "date"), ("vl_", "result"), ("shot", "date"), ("shot", "dose"),
            ("counsel_", "date"), ("counsel_", "outcome"), ("screen_", "date"), ("screen_", "outcome"))]
        typed = normalize(table(spark, dict.fromkeys(names)), LAYOUT, drop_keyless=False)
        ctx = kind(dict(typed.dtypes), LAYOUT, SETTINGS)
        # Rules V03 to V23 name each column that they check.
        rules = [r for r in injectables().rules if r.rule_id > "V26"]
        findings = [f for rule in rules for f in rule.findings(ctx)]
        per_subject = len(getattr(ctx, "aggregates", ())) + len(getattr(ctx, "by_place", ()))
        return len(findings), sum(len(f.when) for f in findings) + sum(map(len, ctx.computed)), per_subject

    for kind in (RowContext, SubjectContext):
        few, many = size(kind, 4), size(kind, 40)
        assert (few[0], few[2]) == (many[0], many[2]) and many[1] < 1.05 * few[1]
