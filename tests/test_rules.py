"""Each rule on hand-written rows: what passes, what fails, nulls and boundaries."""

from datetime import timedelta

import pytest
from tests.helpers import AS_OF, LAYOUT, PACK, SETTINGS, STRICT, table

from cohortcheck import normalize, validate, violations


def found(spark, df, *rules, settings=SETTINGS):
    typed = normalize(df, LAYOUT, drop_keyless=False)
    pack = PACK.only(*rules) if rules else PACK
    return violations(typed, pack, settings, LAYOUT)


# Every case is a subject of its own in one table: the change to a clean row, and the findings
# (rule, first column) that it must cause, no more and no fewer.
def after(days):
    from datetime import date
    return (date(2021, 6, 1) + timedelta(days)).isoformat()


def third(days, dose2, dose3="1"):
    from datetime import date
    return {"shot2_dose": dose2, "shot3_dose": dose3,
            "shot3_date": (date(2021, 7, 2) + timedelta(days)).isoformat()}


TOMORROW = (AS_OF + timedelta(1)).isoformat()
NO_SHOTS = {f"shot{i}_{f}": None for i in (1, 2, 3) for f in ("date", "dose")}
CASES = [
    ({}, []),
    ({"vital_status_alive": "2"}, [("V03", "vital_status_alive")]),
    ({"vital_status_alive": "1.0"}, [("V03", "vital_status_alive")]),
    ({"vital_status_alive": None, "race_white": "NA", "sex_birth": " "}, []),
    ({"ethnicity_hispanic": "x"}, [("V04", "ethnicity_hispanic")]),
    ({"race_white": "3"}, [("V05", "race_white")]),
    ({"gender_id": "6"}, [("V06", "gender_id")]),
    ({"sex_birth": "4"}, [("V07", "sex_birth")]),
    ({"active_2023": "2"}, [("V08", "active_2023")]),
    ({"risk_msm": "2"}, [("V09", "risk_msm")]),
    ({"insurance_status": "9"}, [("V10", "insurance_status")]),
    ({"housing_status": "0"}, [("V11", "housing_status")]),
    ({"employment_status": "4"}, [("V12", "employment_status")]),
    ({"poverty_level": "5"}, [("V13", "poverty_level")]),
    ({"immigration_status_undoc": "2"}, [("V14", "immigration_status_undoc")]),
    ({"language": "9"}, [("V15", "language")]),
    ({"incarceration_history": "4"}, [("V16", "incarceration_history")]),
    ({"vl_2_result": "7", "vl_pre_result": "0"}, [("V17", "vl_2_result"), ("V17", "vl_pre_result")]),
    ({"rx": "1, 2", "rx_date": None}, [("V21", "rx"), ("V44", "rx_date")]),
    ({"shot2_dose": "7"}, [("V22", "shot2_dose")]),
    ({"discontinued": "2"}, [("V23", "discontinued"), ("V47", "discontinued")]),
    ({"not_elig_1_reason": "2,11"}, [("V24", "not_elig_1_reason")]),
    ({"not_elig_1_reason": "1,,20"}, [("V24", "not_elig_1_reason")]),
    ({"not_elig_1_reason": " 11 , 12"}, [("V24", "not_elig_1_reason")] * 2),
    ({"disinterest_reason_1": "7"}, [("V25", "disinterest_reason_1")]),
    ({"discontinued_reason": "99"}, [("V26", "discontinued_reason")]),
    ({"vl_2_date": "2021-01-31"}, [("V27", "vl_1_date")]),
    ({"vl_2_date": "2021-02-01"}, []),
    ({"vl_1_result": None}, [("V28", "vl_1_result")]),
    ({"vl_1_date": None, "vl_1_result": None}, []),
    ({"vl_2_date": TOMORROW}, [("V29", "vl_2_date")]),
    ({"vl_2_date": AS_OF.isoformat()}, []),
    ({"shot2_date": "2021-06-01"}, [("V30", "shot1_date"), ("V35", "shot1_date")]),
    ({"shot2_dose": None}, [("V31", "shot2_dose")]),
    ({"shot1_date": None, "shot1_dose": None}, [("V32", "shot1_date")]),
    ({"shot1_date": None}, []),
    ({"vl_pre_result": None}, [("V33", "vl_pre_result")]),
    ({"vl_pre_result": None, **NO_SHOTS}, []),
    ({"shot2_date": after(38)}, []),
    ({"shot2_date": after(39)}, [("V34", "shot1_date")]),
    ({"shot2_date": after(24)}, []),
    ({"shot2_date": after(23)}, [("V35", "shot1_date")]),
    ({"shot2_date": after(400), "shot2_dose": "4"}, []),
    ({"shot2_date": after(69), "shot1_dose": "6"}, []),
    ({"shot2_date": after(70), "shot1_dose": "6"}, [("V34", "shot1_date")]),
    ({"shot2_date": after(39), "shot1_dose": "2"}, [("V34", "shot1_date")]),
    (third(38, "3"), []),
    (third(39, "4"), [("V34", "shot2_date")]),
    (third(55, "2"), []),
    (third(54, "2"), [("V35", "shot2_date")]),
    (third(69, "6"), []),
    (third(70, "6"), [("V34", "shot2_date")]),
    (third(69, None), [("V31", "shot2_dose")]),
    (third(70, None), [("V31", "shot2_dose"), ("V34", "shot2_date")]),
    (third(24, None), [("V31", "shot2_dose")]),
    (third(23, None), [("V31", "shot2_dose"), ("V35", "shot2_date")]),
    (third(900, "9"), [("V22", "shot2_dose")]),
    ({"shot2_date": TOMORROW, "shot2_dose": "5"}, [("V36", "shot2_date")]),
    ({"counsel_ever": "0"}, [("V38", "counsel_ever")]),
    ({"counsel_ever": None}, [("V38", "counsel_ever")]),
    ({"counsel_ever": None, "counsel_1_outcome": None}, []),
    ({"counsel_ever": "1", "counsel_1_outcome": None, "counsel_1_date": None}, [("V38", "counsel_ever")]),
    ({"screen_ever": "0"}, [("V39", "screen_ever")]),
    ({"counsel_1_date": None, "counsel_1_outcome": None, "counsel_2_date": "2021-03-05",
      "counsel_2_outcome": "3"}, [("V40", "counsel_1_date")]),
    ({"screen_1_date": None, "screen_1_outcome": None, "screen_2_date": "2021-03-05",
      "screen_2_outcome": "1"}, [("V41", "screen_1_date")]),
    ({"rx_date": "2021-02-28"}, [("V42", "rx_date"), ("V43", "rx_date")]),
    ({"rx_date": "2021-03-01"}, [("V43", "rx_date")]),
    ({"rx_date": "2021-06-02"}, [("V44", "rx_date")]),
    ({"rx_date": "2021-06-01"}, []),
    ({"rx": None}, [("V44", "rx_date")]),
    ({"rx": "0", "rx_date": None}, []),
    ({"screen_1_outcome": "0"}, [("V45", "rx")]),
    ({"counsel_1_outcome": "2"}, [("V46", "rx")]),
    ({"counsel_1_outcome": "2", "counsel_2_date": "2021-04-01", "counsel_2_outcome": "3"}, []),
    ({"discontinued": "1", "discontinued_date": "2021-05-01"}, []),
    ({"discontinued": "1", "discontinued_date": "2021-04-30"}, [("V47", "discontinued")]),
    ({"discontinued": "1"}, []),
    ({"discontinued": "0"}, []),
    ({"discontinued": "0", "rx": "0", "rx_date": None, **NO_SHOTS}, [("V47", "discontinued")]),
    ({"counsel_1_date": "2021-01-21"}, [("V48", "counsel_1_date")]),
    ({"counsel_1_date": "2021-01-22"}, []),
    ({"counsel_1_date": "2021-01-21", "counsel_2_date": TOMORROW, **NO_SHOTS}, [("V48", "counsel_2_date")]),
    ({"screen_1_date": "2021-01-21"}, [("V49", "screen_1_date")]),
    ({"discontinued_date": TOMORROW}, [("V51", "discontinued_date")]),
]


@pytest.fixture(scope="module")
def outcome(spark):
    rows = found(spark, table(spark, *[change for change, _ in CASES])).collect()
    got = {}
    for row in rows:
        got.setdefault(int(row.row_id), []).append((row.rule_id, row.column1))
    return got


@pytest.mark.parametrize("at", range(len(CASES)), ids=lambda i: str(CASES[i][0])[:60])
def test_case(outcome, at):
    assert sorted(outcome.get(at, [])) == sorted(CASES[at][1])


def test_prescription_before_approval(spark):
    df = table(spark, {"rx_date": "2021-01-21", "counsel_1_date": None, "screen_1_date": None})
    rows = found(spark, df, "V50").collect()
    assert [(r.column1, r.value1) for r in rows] == [("rx_date", "2021-01-21")]


def test_shot_before_approval(spark):
    df = table(spark, {"shot1_date": "2021-01-21"}, {"shot1_date": "2021-01-22"})
    assert [r.row_id for r in found(spark, df, "V37").collect()] == [0]


def test_subject_without_kept_event_has_no_event_findings(spark):
    late = {f"{e}_{i}_date": "2022-01-01" for e in ("counsel", "screen") for i in (1, 2)}
    df = table(spark, {**late, "rx": None, "counsel_ever": "0"})
    rules = [r.rule_id for r in PACK.rules if r.rule_id >= "V38"]
    assert found(spark, df, *rules).count() == 0


def test_strict_mode_needs_every_row_decided(spark):
    df = table(spark, {"rx_date": "2021-02-28"})
    assert found(spark, df, "V42", "V43", settings=STRICT).count() == 0
    only_counsel = {"screen_1_date": "2021-07-01", "screen_2_date": "2021-07-01", "counsel_2_date": "2021-04-01"}
    df = table(spark, {"rx_date": "2021-02-28", **only_counsel})
    rows = found(spark, df, "V42", settings=STRICT).collect()
    assert [(r.column2, r.value2) for r in rows] == [("counsel_2_date", "2021-04-01")]


def test_strict_mode_takes_the_last_row_of_either_event(spark):
    df = table(spark, {"screen_1_outcome": "0"})
    assert found(spark, df, "V45").count() == 1
    assert found(spark, df, "V45", settings=STRICT).count() == 0  # empty slots come last


def test_keyless_rows_are_reported_and_dropped(spark):
    df = table(spark, {"subject_id": "X-1", "sex_birth": "9"}, {"subject_id": "99999"}, {})
    rows = found(spark, df).collect()
    assert sorted((r.rule_id, r.value1 or "") for r in rows) == [("V02", ""), ("V02", "X-1")]
    assert normalize(df, LAYOUT).count() == 1


def test_repeated_key_flags_every_copy_and_leading_zeros_merge(spark):
    df = table(spark, {"subject_id": "007"}, {"subject_id": "7"}, {})
    rows = found(spark, df, "V01").collect()
    assert sorted((r.row_id, r.value1) for r in rows) == [(0, "7"), (1, "7")]


def test_low_subject_numbers_fail_like_others(spark):
    df = table(spark, {"subject_id": "1", "counsel_ever": "0"}, {"subject_id": "0", "vl_pre_result": None})
    assert sorted(r.rule_id for r in found(spark, df).collect()) == ["V33", "V38"]


def test_previous_slot_is_the_existing_one(spark):
    df = table(spark, {"shot3_date": "2021-06-15"}).drop("shot2_date", "shot2_dose")
    typed = normalize(df, LAYOUT, drop_keyless=False)
    rows = violations(typed, PACK.only("V30", "V35"), SETTINGS, LAYOUT).collect()
    assert [(r.rule_id, r.column1, r.column2) for r in rows] == [("V35", "shot1_date", "shot3_date")]


def test_clean_table_gives_an_empty_report(spark):
    result = validate(table(spark, {}, {}), PACK, SETTINGS, LAYOUT)
    assert result.report.count() == 0
    assert {r.n_missing for r in result.missing.collect()} == {0}


def test_required_column(spark):
    with pytest.raises(ValueError, match="rx_date"):
        found(spark, table(spark, {}).drop("rx_date"))
