"""What each rule is expected to say, written down apart from the rules: its long text and its short one."""

TEXTS: dict[str, tuple[str, str]] = {
    "V01": (
        "This subject id stands on more than one row; each subject needs one row.",
        "Subject id is repeated",
    ),
    "V02": (
        "The subject id is blank or not a number, so the row cannot be checked.",
        "Subject id is missing",
    ),
    "V03": (
        "Vital status must be 0 or 1.",
        "Vital status is not an allowed code",
    ),
    "V04": (
        "Hispanic ethnicity must be 0 or 1.",
        "Hispanic ethnicity is not an allowed code",
    ),
    "V05": (
        "Race must be 0 or 1.",
        "Race is not an allowed code",
    ),
    "V06": (
        "Gender must be 1, 2, 3, 4 or 5.",
        "Gender is not an allowed code",
    ),
    "V07": (
        "Sex at birth must be 1, 2 or 3.",
        "Sex at birth is not an allowed code",
    ),
    "V08": (
        "Active in year must be 0 or 1.",
        "Active in year is not an allowed code",
    ),
    "V09": (
        "Risk factor must be 0 or 1.",
        "Risk factor is not an allowed code",
    ),
    "V10": (
        "Insurance status must be 1, 2, 3, 4, 5, 6, 7 or 8.",
        "Insurance status is not an allowed code",
    ),
    "V11": (
        "Housing status must be 1, 2 or 3.",
        "Housing status is not an allowed code",
    ),
    "V12": (
        "Employment status must be 1, 2 or 3.",
        "Employment status is not an allowed code",
    ),
    "V13": (
        "Poverty level must be 1, 2, 3 or 4.",
        "Poverty level is not an allowed code",
    ),
    "V14": (
        "Undocumented immigration status must be 0 or 1.",
        "Undocumented immigration status is not an allowed code",
    ),
    "V15": (
        "Language must be 1, 2, 3, 4, 5, 6, 7, 8 or 20.",
        "Language is not an allowed code",
    ),
    "V16": (
        "Incarceration history must be 0, 1, 2 or 3.",
        "Incarceration history is not an allowed code",
    ),
    "V17": (
        "Viral load result must be 1, 2, 3, 4, 5 or 6.",
        "Viral load result is not an allowed code",
    ),
    "V18": (
        "Ever counselled or screened must be 0 or 1.",
        "Ever counselled or screened is not an allowed code",
    ),
    "V19": (
        "Counselling outcome must be 1, 2 or 3.",
        "Counselling outcome is not an allowed code",
    ),
    "V20": (
        "Screening outcome must be 0 or 1.",
        "Screening outcome is not an allowed code",
    ),
    "V21": (
        "Prescription must be 0 or 1.",
        "Prescription is not an allowed code",
    ),
    "V22": (
        "Injection dose must be 1, 2, 3, 4, 5 or 6.",
        "Injection dose is not an allowed code",
    ),
    "V23": (
        "Discontinuation must be 0 or 1.",
        "Discontinuation is not an allowed code",
    ),
    "V24": (
        "Each reason for ineligibility must be 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 or 20.",
        "Reason for ineligibility is not an allowed code",
    ),
    "V25": (
        "Each reason for disinterest must be 1, 2, 3, 4, 5, 6 or 20.",
        "Reason for disinterest is not an allowed code",
    ),
    "V26": (
        "Each reason for discontinuation must be 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 or 20.",
        "Reason for discontinuation is not an allowed code",
    ),
    "V27": (
        "Viral loads must be listed from oldest to newest.",
        "Viral loads are out of order",
    ),
    "V28": (
        "A viral load with a date needs a result; enter it or remove the date.",
        "Viral load has no result",
    ),
    "V29": (
        "The viral load date has not come yet.",
        "Viral load date is in the future",
    ),
    "V30": (
        "Injections must be listed from oldest to newest, one per day.",
        "Injections are out of order",
    ),
    "V31": (
        "An injection with a date needs a dose; enter it or remove the date.",
        "Injection has no dose",
    ),
    "V32": (
        "There are later injections, but the first has neither date nor dose; enter it, or move the others up.",
        "First injection is missing",
    ),
    "V33": (
        "A subject on injections needs the viral load from before the first one.",
        "Baseline viral load is missing",
    ),
    "V34": (
        "The injection came later than its schedule allows; check the dates and the dose before.",
        "Injection is late",
    ),
    "V35": (
        "The injection came earlier than its schedule allows; check the dates and the dose before.",
        "Injection is early",
    ),
    "V36": (
        "The injection date has not come yet.",
        "Injection date is in the future",
    ),
    "V37": (
        "The injection date is before the therapy was approved.",
        "Injection date is before approval",
    ),
    "V38": (
        "If ever counselled is 1 there must be a counselling event; if it is 0 or blank there must be none.",
        "Ever counselled contradicts the events",
    ),
    "V39": (
        "If ever screened is 1 there must be a screening event; if it is 0 or blank there must be none.",
        "Ever screened contradicts the events",
    ),
    "V40": (
        "There are later counselling events, but the first one is empty; enter it, or move the others up.",
        "First counselling is missing",
    ),
    "V41": (
        "There are later screening events, but the first one is empty; enter it, or move the others up.",
        "First screening is missing",
    ),
    "V42": (
        "The prescription is dated before every counselling event.",
        "Prescribed before counselling",
    ),
    "V43": (
        "The prescription is dated before every screening event.",
        "Prescribed before screening",
    ),
    "V44": (
        "The first injection is dated before the prescription, or there is no prescription to go with the date.",
        "Started before prescription",
    ),
    "V45": (
        "There is a prescription, but the last screening did not find the subject eligible.",
        "Prescribed though not eligible",
    ),
    "V46": (
        "There is a prescription, but the subject was not interested at the last counselling.",
        "Prescribed though not interested",
    ),
    "V47": (
        "The discontinuation does not follow a prescription, or denies one without any trace of therapy.",
        "Discontinuation does not fit",
    ),
    "V48": (
        "The counselling date is before the therapy was approved or has not come yet.",
        "Counselling date is out of range",
    ),
    "V49": (
        "The screening date is before the therapy was approved or has not come yet.",
        "Screening date is out of range",
    ),
    "V50": (
        "The prescription date is before the therapy was approved or has not come yet.",
        "Prescription date is out of range",
    ),
    "V51": (
        "The discontinuation date is before the therapy was approved or has not come yet.",
        "Discontinuation date is out of range",
    ),
}
