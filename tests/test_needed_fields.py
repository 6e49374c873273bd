"""Slots that no rule can find fault with are left out, and still are the slot before another."""

from cohortcheck import normalize, violations
from cohortcheck.plans.contexts import RowContext
from tests.helpers import LAYOUT, PACK, SETTINGS, table


def test_undated_slots_are_left_out_once(spark):
    typed = normalize(table(spark, {"shot2_date": None, "shot3_date": "2021-05-01"}), LAYOUT)
    ctx = RowContext(dict(typed.dtypes), LAYOUT, SETTINGS)
    items = {f.items for rule in PACK.only("V30", "V34", "V35").rules for f in rule.findings(ctx)}
    items |= {f.items for rule in PACK.only("V31", "V36", "V37").rules for f in rule.findings(ctx)}
    assert len(items) == 2
    for name in items:
        assert len(ctx.checked(typed).select(name).first()[0]) == 2


def test_an_undated_slot_is_the_one_before(spark):
    rows = table(
        spark,
        {"shot2_date": None, "shot3_date": "2021-05-01", "shot3_dose": "1"},
        {"shot2_date": "2021-05-01"},
        {"subject_id": "9", "shot2_date": None, "shot3_date": "2021-05-01"},
        {"subject_id": "9", "shot1_date": "2021-04-01", "shot2_date": None},
    )
    found = violations(normalize(rows, LAYOUT), PACK.only("V30"), SETTINGS, LAYOUT).collect()
    # Subject 9: the second row's first slot follows the first row's; third slots follow each other.
    assert sorted((r.subject_id, r.column1, r.value2) for r in found) == [
        (2.0, "shot1_date", "2021-05-01"),
        (9.0, "shot1_date", "2021-04-01"),
    ]
