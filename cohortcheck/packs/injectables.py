"""Rules for a cohort on long-acting injectable therapy.

One row per subject with demographics, viral loads, counselling and screening events, the
prescription, injections and discontinuation. All clinical names, codes and bounds live here.
"""

from __future__ import annotations

from dataclasses import dataclass

from cohortcheck.functions import any_of, any_true, column, contains, holds, quoted, ref, text_of
from cohortcheck.operators.reshape import SlotFamily
from cohortcheck.plans.contexts import Context, Previous, RowContext, SubjectContext
from cohortcheck.plans.rules import (
    Bound,
    CellRule,
    CodeListRule,
    EachFinding,
    Finding,
    KeyPresentRule,
    KeyUniqueRule,
    SlotRule,
    SubjectRule,
    interval_rule,
)
from cohortcheck.plans.validation import Pack

AnyContext = RowContext | SubjectContext
EVENTS = ("counsel", "screen")

# The codes that each coded column may hold.
YES_NO = ("0", "1")
UP_TO_3 = ("1", "2", "3")
UP_TO_4 = ("1", "2", "3", "4")
UP_TO_5 = ("1", "2", "3", "4", "5")
UP_TO_6 = ("1", "2", "3", "4", "5", "6")
UP_TO_8 = ("1", "2", "3", "4", "5", "6", "7", "8")
LANGUAGES = (*UP_TO_8, "20")
INCARCERATION = ("0", "1", "2", "3")
NOT_ELIGIBLE_REASONS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "20")
DISINTEREST_REASONS = ("1", "2", "3", "4", "5", "6", "20")
INTERESTED = "3"
ELIGIBLE = "1"

# Allowed days between injections, by the dose code of the injection before. A month
# is 31 days, two months are 62, and a week either way is on time. Doses given elsewhere are exempt.
EXEMPT_DOSES = ("4", "5", "6")
DOSE_BOUNDS = (
    Bound(codes=("6",), earliest=24, latest=38, after_index=1),  # after the first, any dose but 6
    Bound(codes=("1", "3", "4", "5"), earliest=24, latest=38),
    Bound(codes=("2", "6"), earliest=55, latest=69),
    Bound(codes=None, earliest=24, latest=69),
)


@dataclass(frozen=True)
class Names:
    """Column names and slot templates. A viral load may have a key of any text; names with a part of ``other_loads`` are none."""

    viral_load: str
    baseline: str
    shot: str
    event: str
    ever: str
    rx: str
    rx_date: str
    discontinued: str
    discontinued_date: str
    other_loads: tuple[str, ...]

    @property
    def viral_loads(self) -> SlotFamily:
        fields = {"date": "date", "result": "string"}
        return SlotFamily(self.viral_load, fields, keys=".*", without=self.other_loads)

    @property
    def shots(self) -> SlotFamily:
        return SlotFamily(self.shot, {"date": "date", "dose": "string"})

    @property
    def events(self) -> SlotFamily:
        return SlotFamily(self.event, {"date": "date", "outcome": "string"}, EVENTS)

    def shot_date(self, index: int) -> str:
        return self.shots.name(index, "date")


SHORT_NAMES = Names(
    viral_load="vl_{index}_{field}",
    baseline="vl_pre_result",
    shot="shot{index}_{field}",
    event="{event}_{index}_{field}",
    ever="{event}_ever",
    rx="rx",
    rx_date="rx_date",
    discontinued="discontinued",
    discontinued_date="discontinued_date",
    other_loads=("dx", "vl_pre_"),
)

# The column names of the clinical template.
CLINICAL_NAMES = Names(
    viral_load="hiv_vl_{index}_{field}",
    baseline="hiv_vl_pre_icab_result",
    shot="icab_rpv_shot{index}_{field}",
    event="icab_rpv_{event}_{index}_{field}",
    ever="icab_rpv_{event}_ever",
    rx="icab_rpv_rx",
    rx_date="icab_rpv_rx_date",
    discontinued="icab_rpv_discontinued",
    discontinued_date="icab_rpv_discontinued_date",
    other_loads=("dx", "pre_icab"),
)


def injectables(names: Names = SHORT_NAMES) -> Pack:
    """All rules V01 to V51, and the demographic columns to profile."""
    return Pack(
        rules=(
            *_keys(),
            *_domains(names),
            *_reasons(),
            *_viral_loads(names),
            *_shots(names),
            *_events(names),
        ),
        profiled=(
            column("vital_status_alive", "zip_code", "age", "ethnicity_hispanic"),
            contains("race") & ~contains("other"),
            column("sex_birth"),
            contains("risk"),
            column(
                "insurance_status",
                "housing_status",
                "employment_status",
                "poverty_level",
                "immigration_status_undoc",
                "language",
                "incarceration_history",
            ),
            contains("active"),
        ),
    )


def _keys() -> list:
    return [
        KeyUniqueRule("V01", "This subject id stands on more than one row; each subject needs one row.",
                      "Subject id is repeated"),
        KeyPresentRule("V02", "The subject id is blank or not a number, so the row cannot be checked.",
                       "Subject id is missing"),
    ]


def _domains(names: Names) -> list[CellRule]:
    def rule(rule_id, what, selector, allowed):
        listed = f"{', '.join(allowed[:-1])} or {allowed[-1]}"
        return CellRule(rule_id, f"{what} must be {listed}.", f"{what} is not an allowed code",
                        selector, allowed)

    return [
        rule("V03", "Vital status", column("vital_status_alive"), YES_NO),
        rule("V04", "Hispanic ethnicity", column("ethnicity_hispanic"), YES_NO),
        rule("V05", "Race", contains("race") & ~contains("specify") & ~contains("changes"), YES_NO),
        rule("V06", "Gender", any_of("gender_id"), UP_TO_5),
        rule("V07", "Sex at birth", column("sex_birth"), UP_TO_3),
        rule("V08", "Active in year", contains("active"), YES_NO),
        rule("V09", "Risk factor", contains("risk"), YES_NO),
        rule("V10", "Insurance status", column("insurance_status"), UP_TO_8),
        rule("V11", "Housing status", column("housing_status"), UP_TO_3),
        rule("V12", "Employment status", column("employment_status"), UP_TO_3),
        rule("V13", "Poverty level", column("poverty_level"), UP_TO_4),
        rule("V14", "Undocumented immigration status", any_of("immigration_status_undoc"), YES_NO),
        rule("V15", "Language", column("language"), LANGUAGES),
        rule("V16", "Incarceration history", column("incarceration_history"), INCARCERATION),
        rule("V17", "Viral load result", contains("vl") & contains("result"), UP_TO_6),
        rule("V18", "Ever counselled or screened", contains("ever"), YES_NO),
        rule("V19", "Counselling outcome", contains("counsel") & contains("outcome"), UP_TO_3),
        rule("V20", "Screening outcome", contains("screen") & contains("outcome"), YES_NO),
        rule("V21", "Prescription", contains("rx") & ~contains("date"), YES_NO),
        rule("V22", "Injection dose", contains("_dose"), UP_TO_6),
        rule("V23", "Discontinuation", column(names.discontinued), YES_NO),
    ]


def _reasons() -> list[CodeListRule]:
    def rule(rule_id, what, part, allowed):
        listed = f"{', '.join(allowed[:-1])} or {allowed[-1]}"
        return CodeListRule(rule_id, f"Each reason for {what} must be {listed}.",
                            f"Reason for {what} is not an allowed code",
                            contains(part) & contains("reason") & ~contains("oth"), allowed)

    return [
        rule("V24", "ineligibility", "not_elig", NOT_ELIGIBLE_REASONS),
        rule("V25", "disinterest", "disinterest", DISINTEREST_REASONS),
        rule("V26", "discontinuation", "discontinued", NOT_ELIGIBLE_REASONS),
    ]


def _viral_loads(names: Names) -> list[SlotRule]:
    family = names.viral_loads

    def out_of_order(ctx: Context, cells: dict[str, str], previous: Previous) -> str:
        return f"{cells['date']} < {previous.values['date']}"

    def without_result(ctx, cells, previous):
        return f"{cells['result']} IS NULL AND {cells['date']} IS NOT NULL"

    def in_future(ctx, cells, previous):
        return ctx.future(cells["date"])

    return [
        SlotRule("V27", "Viral loads must be listed from oldest to newest.",
                 "Viral loads are out of order", family, out_of_order, ("<date", "date"), needs="date"),
        SlotRule("V28", "A viral load with a date needs a result; enter it or remove the date.",
                 "Viral load has no result", family, without_result, ("result",), needs="date"),
        SlotRule("V29", "The viral load date has not come yet.",
                 "Viral load date is in the future", family, in_future, ("date",), needs="date"),
    ]


def _shots(names: Names) -> list:
    family = names.shots

    # A slot with a date makes its subject "on therapy", so only rules that may fire on a slot
    # without one have to ask.
    def on_therapy(ctx: AnyContext) -> str:
        return ctx.any(f"exists({ctx.slots(family)}, _e -> _e.date IS NOT NULL)")

    def not_after(ctx: Context, cells: dict[str, str], previous: Previous) -> str:
        return f"{cells['date']} <= {previous.values['date']}"

    def without_dose(ctx, cells, previous):
        return f"{cells['dose']} IS NULL AND {cells['date']} IS NOT NULL"

    def first_missing(ctx: AnyContext) -> list[Finding]:
        out = []
        for slot in family.slots(ctx.columns):
            if slot.index == 1:
                empty = " AND ".join(f"{ctx.col(slot.column(f))} IS NULL" for f in family.fields)
                bad = f"{on_therapy(ctx)} AND {ctx.on_first(empty)}"
                out.append(Finding(bad, quoted(family.shown(slot, "date")), ctx.text(slot.column("date"))))
        return out

    def baseline_missing(ctx: AnyContext) -> list[Finding]:
        _require(ctx, names.baseline)
        missing = ctx.on_first(f"{ctx.col(names.baseline)} IS NULL")
        return [Finding(f"{on_therapy(ctx)} AND {missing}", *_cell(ctx, names.baseline))]

    def in_future(ctx, cells, previous):
        return ctx.future(cells["date"])

    def too_early(ctx, cells, previous):
        return ctx.too_early(cells["date"])

    doses = {"exempt": EXEMPT_DOSES, "bounds": DOSE_BOUNDS}
    return [
        SlotRule("V30", "Injections must be listed from oldest to newest, one per day.",
                 "Injections are out of order", family, not_after, ("<date", "date"), needs="date"),
        SlotRule("V31", "An injection with a date needs a dose; enter it or remove the date.",
                 "Injection has no dose", family, without_dose, ("dose",), needs="date"),
        SubjectRule("V32", "There are later injections, but the first has neither date nor dose; "
                    "enter it, or move the others up.", "First injection is missing", first_missing),
        SubjectRule("V33", "A subject on injections needs the viral load from before the first one.",
                    "Baseline viral load is missing", baseline_missing),
        interval_rule("V34", "The injection came later than its schedule allows; check the dates and the "
                      "dose before.", "Injection is late", family, side="late", **doses),
        interval_rule("V35", "The injection came earlier than its schedule allows; check the dates and "
                      "the dose before.", "Injection is early", family, side="early", **doses),
        SlotRule("V36", "The injection date has not come yet.", "Injection date is in the future",
                 family, in_future, ("date",), needs="date"),
        SlotRule("V37", "The injection date is before the therapy was approved.",
                 "Injection date is before approval", family, too_early, ("date",), needs="date"),
    ]


def _require(ctx: Context, *wanted: str) -> None:
    column(*wanted)(ctx.columns)


def _cell(ctx: Context, name: str) -> tuple[str, str]:
    """Name and text of a cell, to show in a finding."""
    return quoted(ctx.real(name) or name), ctx.text(name)


class _Course:
    """The events of a row around its prescription, as seen by the event rules.

    An event after the first injection does not count. ``events`` is the array of all event slots, ``kept`` of those
    that count; :meth:`of` has those of one kind, so that a question about them goes through no others. Conditions are about
    an element ``_e``.
    """

    def __init__(self, ctx: AnyContext, names: Names):
        _require(
            ctx, names.rx, names.rx_date, names.discontinued, names.discontinued_date,
            names.shot_date(1), names.shot_date(2), *[names.ever.format(event=e) for e in EVENTS],
        )
        self.ctx, self.names, self.family = ctx, names, names.events
        rx, self.rx_date = ctx.col(names.rx), ctx.col(names.rx_date)
        self.prescribed = ctx.fact(holds(f"{rx} = '1'"))
        self.not_prescribed = f"(({rx} IS NULL OR {rx} = '0') AND {self.rx_date} IS NULL)"
        start = ctx.col(names.shot_date(1))
        self.events = ctx.slots(self.family)
        self.counts = f"{start} IS NULL OR _e.date IS NULL OR _e.date <= {start}"
        self.kept = ctx.fact(f"filter({self.events}, _e -> {self.counts})")

    some = "(_e.date IS NOT NULL OR _e.outcome IS NOT NULL)"
    full = "_e.date IS NOT NULL AND _e.outcome IS NOT NULL"

    def has(self, event: str) -> bool:
        """Has the table a slot of that kind?"""
        return any(slot.event == event for slot in self.family.slots(self.ctx.columns))

    def of(self, event: str) -> str:
        """The events of that kind that count."""
        return self.ctx.fact(f"filter({self.events}, _e -> _e.event = {quoted(event)} AND ({self.counts}))")

    def exists(self, event: str, cond: str) -> str:
        """Is there an event of that kind that counts, and for which ``cond`` holds?"""
        return f"exists({self.of(event)}, _e -> {holds(cond)})"

    @property
    def any_counts(self) -> str:
        """Does the row keep any event? Subjects without one are not checked."""
        return f"(size({self.kept}) > 0)"

    @property
    def after_rx(self) -> str:
        """Is the event dated after the prescription?"""
        return f"({self.prescribed} AND {holds(f'_e.date > {self.rx_date}')})"

    def supported(self, event: str) -> str:
        """An event that counts and precedes the prescription, or there is no prescription."""
        before = self.exists(event, f"{self.prescribed} AND _e.date <= {self.rx_date}")
        return any_true([before, f"{holds(self.not_prescribed)} AND {self.any_counts}"])

    def wrong_outcome(self, wanted: str) -> str:
        """Does the outcome speak against the prescription?"""
        return f"({self.prescribed} AND {holds(f'_e.outcome <> {quoted(wanted)}')})"

    def largest(self, event: str, cond: str) -> str:
        """The highest slot number among the events of that kind that count and for which ``cond`` holds, of the subject."""
        marked = f"filter({self.of(event)}, _e -> {cond})"
        return self.ctx.max(f"array_max(transform({marked}, _e -> _e.index))")

    def at(self, event: str, index: str, part: str) -> tuple[str, str]:
        """Name and text of a field of the slot with a computed number."""
        slot = f"get(filter({self.events}, _e -> _e.event = {quoted(event)} AND _e.index = {index}), 0)"
        return f"{slot}.{part}_name", text_of(f"{slot}.{part}", self.family.fields[part])


def _events(names: Names) -> list[SubjectRule]:
    def ever(event: str):
        def make(ctx: AnyContext) -> list[Finding]:
            course, name = _Course(ctx, names), names.ever.format(event=event)
            cell, kept = ctx.col(name), course.any_counts
            not_all_1 = ctx.any(f"{kept} AND NOT {holds(f'{cell} = {quoted("1")}')}")
            not_all_0 = ctx.any(f"{kept} AND NOT {holds(f'{cell} = {quoted("0")}')}")
            not_all_null = ctx.any(f"{kept} AND {cell} IS NOT NULL")
            some = ctx.any(course.exists(event, course.some))
            full = ctx.any(course.exists(event, course.full))
            fine = (
                f"(NOT {not_all_1} AND {some}) OR (NOT ({not_all_0} AND {not_all_null}) AND NOT {full})"
            )
            return [Finding(ctx.once(f"{ctx.any(kept)} AND NOT ({fine})"), *_cell(ctx, name))]

        return make

    def first_slot(event: str):
        def make(ctx: AnyContext) -> list[Finding]:
            course = _Course(ctx, names)
            full = ctx.any(course.exists(event, course.full))
            first = ctx.any(course.exists(event, f"_e.index = 1 AND {course.some}"))
            shown = [course.family.name(1, part, event) for part in ("date", "outcome")]
            return [Finding(ctx.once(f"{full} AND NOT {first}"),
                            *_cell(ctx, shown[0]), *_cell(ctx, shown[1]))]

        return make

    def rx_before(event: str):
        def make(ctx: AnyContext) -> list[Finding]:
            course = _Course(ctx, names)
            if not course.has(event):
                return []
            late = course.after_rx
            if ctx.settings.mode == "strict":
                spared = f"exists({course.kept}, _e -> _e.event <> {quoted(event)} OR NOT {late})"
            else:
                spared = course.supported(event)
            bad = f"{ctx.any(course.exists(event, late))} AND NOT {ctx.any(spared)}"
            index = course.largest(event, late)
            return [Finding(ctx.once(bad), *_cell(ctx, names.rx_date), *course.at(event, index, "date"))]

        return make

    def rx_despite(event: str, wanted: str):
        def make(ctx: AnyContext) -> list[Finding]:
            course = _Course(ctx, names)
            if not course.has(event):
                return []
            against = course.wrong_outcome(wanted)
            verdict = f"CASE WHEN {course.prescribed} THEN _e.outcome <> {quoted(wanted)} END"
            candidates = course.kept
            if ctx.settings.mode == "strict":
                verdict = f"CASE WHEN _e.event = {quoted(event)} THEN {verdict} END"
            else:
                candidates = f"filter({course.of(event)}, _e -> {course.full})"
            last = ctx.last(
                f"transform({candidates}, _e -> named_struct('undated', _e.date IS NULL, 'day', _e.date, "
                f"'row', {ref(ctx.layout.row)}, 'place', _e.place, 'outcome', {verdict}))"
            )
            bad = f"{ctx.any(course.exists(event, against))} AND {holds(last)}"
            index = course.largest(event, against)
            return [Finding(ctx.once(bad), *_cell(ctx, names.rx), *course.at(event, index, "outcome"))]

        return make

    def started_before_rx(ctx: AnyContext) -> list[Finding]:
        course, start = _Course(ctx, names), ctx.col(names.shot_date(1))
        fits = f"{start} IS NULL OR {course.rx_date} IS NULL OR {start} >= {course.rx_date}"
        fine = f"({course.prescribed} AND ({fits})) OR {course.not_prescribed}"
        bad = f"{ctx.any(course.any_counts)} AND {ctx.on_first(f'NOT {holds(fine)}')}"
        return [Finding(bad, *_cell(ctx, names.rx_date), *_cell(ctx, names.shot_date(1)))]

    def discontinuation(ctx: AnyContext) -> list[Finding]:
        course = _Course(ctx, names)
        code, day = ctx.col(names.discontinued), ctx.col(names.discontinued_date)
        traces = [course.rx_date, ctx.col(names.shot_date(1)), ctx.col(names.shot_date(2))]
        fine = (
            f"{code} IS NULL OR ({code} = '1' AND ({day} IS NULL OR {holds(f'{day} >= {course.rx_date}')})) "
            f"OR ({code} = '0' AND {any_true(f'{d} IS NOT NULL' for d in traces)})"
        )
        bad = f"{ctx.any(course.any_counts)} AND {ctx.on_first(f'NOT {holds(fine)}')}"
        return [Finding(bad, *_cell(ctx, names.discontinued))]

    def extreme_event(event: str):
        def make(ctx: AnyContext) -> list[EachFinding]:
            course = _Course(ctx, names)

            def places(cond: str) -> str:
                marked = f"filter({course.of(event)}, _e -> {cond})"
                return ctx.fact(f"transform({marked}, _e -> _e.place)")

            future, early = places(ctx.future("_e.date")), places(ctx.too_early("_e.date"))
            any_future = ctx.any(f"size({future}) > 0")
            first_future, first_early = ctx.first_at(future)("_e.place"), ctx.first_at(early)("_e.place")
            bad = f"{first_future} OR (NOT {any_future} AND {first_early})"
            return [EachFinding(course.events, "_e", Finding(bad, "_e.date_name", text_of("_e.date", "date")))]

        return make

    def extreme_day(name: str):
        def make(ctx: AnyContext) -> list[Finding]:
            course, day = _Course(ctx, names), ctx.col(name)
            bad = f"{course.any_counts} AND ({ctx.future(day)} OR {ctx.too_early(day)})"
            return [Finding(ctx.on_first(bad), *_cell(ctx, name))]

        return make

    def extreme_texts(what: str) -> tuple[str, str]:
        return (f"The {what} date is before the therapy was approved or has not come yet.",
                f"{what.capitalize()} date is out of range")

    return [
        SubjectRule("V38", "If ever counselled is 1 there must be a counselling event; if it is 0 or "
                    "blank there must be none.", "Ever counselled contradicts the events", ever("counsel")),
        SubjectRule("V39", "If ever screened is 1 there must be a screening event; if it is 0 or blank "
                    "there must be none.", "Ever screened contradicts the events", ever("screen")),
        SubjectRule("V40", "There are later counselling events, but the first one is empty; enter it, or "
                    "move the others up.", "First counselling is missing", first_slot("counsel")),
        SubjectRule("V41", "There are later screening events, but the first one is empty; enter it, or "
                    "move the others up.", "First screening is missing", first_slot("screen")),
        SubjectRule("V42", "The prescription is dated before every counselling event.",
                    "Prescribed before counselling", rx_before("counsel")),
        SubjectRule("V43", "The prescription is dated before every screening event.",
                    "Prescribed before screening", rx_before("screen")),
        SubjectRule("V44", "The first injection is dated before the prescription, or there is no "
                    "prescription to go with the date.", "Started before prescription", started_before_rx),
        SubjectRule("V45", "There is a prescription, but the last screening did not find the subject "
                    "eligible.", "Prescribed though not eligible", rx_despite("screen", ELIGIBLE)),
        SubjectRule("V46", "There is a prescription, but the subject was not interested at the last "
                    "counselling.", "Prescribed though not interested", rx_despite("counsel", INTERESTED)),
        SubjectRule("V47", "The discontinuation does not follow a prescription, or denies one without "
                    "any trace of therapy.", "Discontinuation does not fit", discontinuation),
        SubjectRule("V48", *extreme_texts("counselling"), extreme_event("counsel")),
        SubjectRule("V49", *extreme_texts("screening"), extreme_event("screen")),
        SubjectRule("V50", *extreme_texts("prescription"), extreme_day(names.rx_date)),
        SubjectRule("V51", *extreme_texts("discontinuation"), extreme_day(names.discontinued_date)),
    ]
