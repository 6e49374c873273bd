"""A small cohort row with every column the pack needs."""

from __future__ import annotations

from datetime import date

from cohortcheck import Layout, Settings
from cohortcheck.packs import injectables

AS_OF = date(2024, 6, 30)
SETTINGS = Settings(as_of=AS_OF)
STRICT = Settings(as_of=AS_OF, mode="strict")
PACK = injectables()
LAYOUT = Layout()

CLEAN = {
    "subject_id": "1", "vital_status_alive": "1", "zip_code": "10001", "age": "40",
    "ethnicity_hispanic": "0", "race_white": "1", "race_specify": "text", "active_2023": "1",
    "risk_msm": "0", "gender_id": "1", "sex_birth": "1", "insurance_status": "1",
    "housing_status": "1", "employment_status": "1", "poverty_level": "1",
    "immigration_status_undoc": "0", "language": "20", "incarceration_history": "0",
    "vl_1_date": "2021-02-01", "vl_1_result": "1", "vl_2_date": "2021-03-01", "vl_2_result": "1",
    "vl_pre_result": "1",
    "shot1_date": "2021-06-01", "shot1_dose": "1", "shot2_date": "2021-07-02", "shot2_dose": "1",
    "shot3_date": None, "shot3_dose": None,
    "counsel_ever": "1", "counsel_1_date": "2021-03-01", "counsel_1_outcome": "3",
    "counsel_2_date": None, "counsel_2_outcome": None,
    "screen_ever": "1", "screen_1_date": "2021-03-02", "screen_1_outcome": "1",
    "screen_2_date": None, "screen_2_outcome": None,
    "rx": "1", "rx_date": "2021-05-01", "discontinued": None, "discontinued_date": None,
    "not_elig_1_reason": "1, 3", "disinterest_reason_1": "20", "discontinued_reason": "10",
}


def table(spark, *changes):
    """One row per change set; the row id is the position, the subject id too unless given."""
    rows = [
        {**CLEAN, "subject_id": str(i + 1), **change, "row_id": change.get("row_id", i)}
        for i, change in enumerate(changes)
    ]
    names = list(dict.fromkeys(n for row in rows for n in row))
    schema = ", ".join(f"`{n}` {'bigint' if n == 'row_id' else 'string'}" for n in names)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)
