"""DuckDB SQL for every registered query, written over long tables and windows.

The Spark plan checks wide rows in place; the SQL here spells the same rules out the other way,
slot by slot and subject by subject.
"""

from __future__ import annotations

from cohort_queries.cohort import (
    GENDER,
    N_EVENTS,
    N_SHOTS,
    N_VIRAL_LOADS,
    cohort_columns,
    cohort_sql,
    dirty_columns,
    dirty_sql,
    site_cells,
)
from cohort_queries.texts import TEXTS

AS_OF = "2024-06-30"
NOT_BEFORE = "2021-01-22"
TOKENS = "'', 'NA', 'UNK', 'Unk', 'N/A', '88888', '888888', '99999', '999999'"
COLUMNS = list(cohort_columns())
DATES = [c for c in COLUMNS if "date" in c]
EVENTS = ("counsel", "screen")

PROFILED = [
    "vital_status_alive", "zip_code", "age", "ethnicity_hispanic", "race_white", "race_black", "sex_birth",
    "risk_msm", "insurance_status", "housing_status", "employment_status", "poverty_level",
    "immigration_status_undoc", "language", "incarceration_history", "active_2023", "active_2024",
]


def _codes(*values: object) -> str:
    return ", ".join(f"'{v}'" for v in values)


YES_NO = _codes(0, 1)
NEVER_PRESCRIBED = "(coalesce(rx, '0') = '0' AND rx_date IS NULL)"
DOMAINS = {
    "V03": (["vital_status_alive"], YES_NO),
    "V04": (["ethnicity_hispanic"], YES_NO),
    "V05": (["race_white", "race_black"], YES_NO),
    "V06": (["gender_id"], _codes(*range(1, 6))),
    "V07": (["sex_birth"], _codes(1, 2, 3)),
    "V08": (["active_2023", "active_2024"], YES_NO),
    "V09": (["risk_msm"], YES_NO),
    "V10": (["insurance_status"], _codes(*range(1, 9))),
    "V11": (["housing_status"], _codes(1, 2, 3)),
    "V12": (["employment_status"], _codes(1, 2, 3)),
    "V13": (["poverty_level"], _codes(1, 2, 3, 4)),
    "V14": (["immigration_status_undoc"], YES_NO),
    "V15": (["language"], _codes(*range(1, 9), 20)),
    "V16": (["incarceration_history"], _codes(0, 1, 2, 3)),
    "V17": ([f"vl_{i}_result" for i in (1, 2, 3)] + ["vl_pre_result"], _codes(*range(1, 7))),
    "V18": (["counsel_ever", "screen_ever"], YES_NO),
    "V19": (["counsel_1_outcome", "counsel_2_outcome"], _codes(1, 2, 3)),
    "V20": (["screen_1_outcome", "screen_2_outcome"], YES_NO),
    "V21": (["rx"], YES_NO),
    "V22": ([f"shot{i}_dose" for i in range(1, N_SHOTS + 1)], _codes(*range(1, 7))),
    "V23": (["discontinued"], YES_NO),
}
REASONS = {
    "V24": ("not_elig_1_reason", _codes(*range(1, 11), 20)),
    "V25": ("disinterest_reason_1", _codes(*range(1, 7), 20)),
    "V26": ("discontinued_reason", _codes(*range(1, 11), 20)),
}


def _clean(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ({TOKENS}) THEN trim({c}) END"


def _date(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '/') THEN CAST(try_strptime({c}, '%m/%d/%Y') AS DATE) "
        f"WHEN contains({c}, '-') THEN CAST(try_strptime({c}, '%Y-%m-%d') AS DATE) "
        f"ELSE DATE '1899-12-30' + CAST(floor(TRY_CAST({c} AS DOUBLE)) AS INTEGER) END"
    )


def _typed(c: str) -> str:
    if "date" in c:
        return f"{_date(c)} AS {c}"
    return f"TRY_CAST({c} AS DOUBLE) AS {c}" if c == "age" else c


def _slots(fields: dict[str, str], numbers: range, extra: str = "") -> str:
    """UNION ALL of the slots of table ``t``; ``{i}`` in a field stands for the slot number."""
    return "\n  UNION ALL\n  ".join(
        "SELECT subject_id, copy, " + f"CAST({i} AS INTEGER) AS idx, "
        + ", ".join(f"{e.format(i=i)} AS {name}" for name, e in fields.items()) + f"{extra} FROM t"
        for i in numbers
    )


def base(site: str = "''", n_shots: int = N_SHOTS, where: str = "true", cells: dict[str, str] | None = None,
         gender: str = "NULL") -> str:
    """Common table expressions: n and t (typed rows, with and without key), vl, sh, ev, r.

    ``where`` picks the orders; ``cells`` says what stands in a column instead of its cell, ``gender`` in one that is absent.
    """
    columns = list(cohort_columns(n_shots))
    cells = cells or {}
    by_slot = "OVER (PARTITION BY site, subject_id ORDER BY idx, copy)"
    carried = ", site, k"
    events = "\n  UNION ALL\n  ".join(
        f"SELECT subject_id, copy, '{e}' AS event, {o} AS eo, CAST({i} AS INTEGER) AS idx, "
        f"{e}_{i}_date AS date, {e}_{i}_outcome AS outcome, counsel_ever, screen_ever, rx, rx_date, "
        f"shot1_date AS anchor_date, discontinued, discontinued_date{carried} FROM t"
        for o, e in enumerate(EVENTS) for i in range(1, N_EVENTS + 1)
    )
    return f"""WITH {cohort_sql(n_shots, where)},
cl AS (SELECT {_clean('subject_id')} AS subject_id_text, CAST(copy AS BIGINT) AS copy, k, {site} AS site,
  {", ".join(f"{_clean(cells.get(c, c))} AS {c}" for c in columns)} FROM f),
n AS (SELECT CASE WHEN regexp_full_match(subject_id_text, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
    THEN TRY_CAST(subject_id_text AS DOUBLE) END AS subject_id, subject_id_text, copy, k, site,
  {", ".join(_typed(c) for c in columns)},
  CAST({gender} AS VARCHAR) AS gender_id, CAST(NULL AS VARCHAR) AS immigration_status_undoc FROM cl),
t AS (SELECT * FROM n WHERE subject_id IS NOT NULL),
r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY site, subject_id ORDER BY copy) = 1),
vl0 AS ({_slots({"date": "vl_{i}_date", "result": "vl_{i}_result"}, range(1, N_VIRAL_LOADS + 1), carried)}),
vl AS (SELECT *, lag(date) {by_slot} AS pdate, lag(idx) {by_slot} AS pidx FROM vl0),
sh0 AS ({_slots({"date": "shot{i}_date", "dose": "shot{i}_dose", "pre": "vl_pre_result"},
                range(1, n_shots + 1), carried)}),
sh1 AS (SELECT *, lag(date) {by_slot} AS pdate, lag(idx) {by_slot} AS pidx, lag(dose) {by_slot} AS pdose,
  bool_or(date IS NOT NULL) OVER (PARTITION BY site, subject_id) AS on_therapy FROM sh0),
sh AS (SELECT *, date_diff('day', pdate, date) AS gap,
  CASE WHEN dose IN ('4', '5', '6') THEN 'none' WHEN pidx = 1 AND pdose <> '6' THEN 'month'
       WHEN pdose IN ('1', '3', '4', '5') THEN 'month' WHEN pdose IN ('2', '6') THEN 'two'
       WHEN pdose IS NULL THEN 'unknown' ELSE 'none' END AS plan FROM sh1),
ev0 AS ({events}),
ev AS (SELECT * FROM ev0 WHERE anchor_date IS NULL OR date <= anchor_date OR date IS NULL),
kept AS (SELECT DISTINCT site, subject_id FROM ev)
"""


def _row(rule: str, c1: str, v1: str, c2: str = "NULL", v2: str = "NULL", alias: str = "", sid: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (
        f"SELECT {p}site AS site, {sid or p + 'subject_id'} AS subject_id, {p}copy AS copy, "
        f"'{rule}' AS rule_id, {c1} AS column1, CAST({v1} AS VARCHAR) AS value1, "
        f"CAST({c2} AS VARCHAR) AS column2, CAST({v2} AS VARCHAR) AS value2"
    )


def _pick(event: str, field: str, idx: str) -> str:
    cases = " ".join(f"WHEN {i} THEN r.{event}_{i}_{field}" for i in range(1, N_EVENTS + 1))
    return f"CASE {idx} {cases} END"


def _offender(rule: str, name: str, bad: str, *shown: str, kept: bool = True) -> str:
    """First row of each subject for which ``bad`` holds, if the subject keeps an event."""
    only = "(site, subject_id) IN (SELECT site, subject_id FROM kept) AND " if kept else ""
    return (
        f"SELECT site, subject_id, copy, rule_id, column1, value1, column2, value2 FROM ("
        f"{_row(rule, *(shown or (f"'{name}'", name)))}, row_number() OVER "
        f"(PARTITION BY site, subject_id ORDER BY copy) AS rn FROM t WHERE {only}({bad})) WHERE rn = 1"
    )


def rule_sql(mode: str = "default", n_shots: int = N_SHOTS) -> dict[str, str]:
    """One SELECT per rule over the tables of :func:`base`."""
    out = {
        "V01": _row("V01", "'subject_id'", "CAST(subject_id AS BIGINT)")
        + " FROM t QUALIFY count(*) OVER (PARTITION BY site, subject_id) > 1",
        "V02": _row("V02", "'subject_id'", "subject_id_text", sid="CAST(NULL AS DOUBLE)")
        + " FROM n WHERE subject_id IS NULL",
    }
    for rule, (columns, allowed) in DOMAINS.items():
        columns = [f"shot{i}_dose" for i in range(1, n_shots + 1)] if rule == "V22" else columns
        out[rule] = " UNION ALL ".join(
            f"{_row(rule, f"'{c}'", c)} FROM t WHERE {c} NOT IN ({allowed})" for c in columns
        )
    for rule, (c, allowed) in REASONS.items():
        out[rule] = (
            f"{_row(rule, f"'{c}'", c)} FROM (SELECT *, unnest(string_split({c}, ',')) AS code FROM t) "
            f"WHERE trim(code) NOT IN ({allowed})"
        )

    def slot(rule: str, table: str, name: str, fields: str, bad: str) -> str:
        pairs = []
        for f in fields.split():
            prev = f.startswith("<")
            part = f.lstrip("<")
            idx = "pidx" if prev else "idx"
            shown = part if part != "date" or not prev else "pdate"
            pairs += [f"'{name}' || CAST({idx} AS VARCHAR) || '_{part}'", shown]
        return f"{_row(rule, *pairs)} FROM {table} WHERE {bad}"

    future, early = f"date > DATE '{AS_OF}'", f"date < DATE '{NOT_BEFORE}'"
    late = "CASE plan WHEN 'month' THEN gap > 38 WHEN 'two' THEN gap > 69 WHEN 'unknown' THEN gap > 69 END"
    soon = "CASE plan WHEN 'month' THEN gap < 24 WHEN 'two' THEN gap < 55 WHEN 'unknown' THEN gap < 24 END"
    out |= {
        "V27": slot("V27", "vl", "vl_", "<date date", "date < pdate"),
        "V28": slot("V28", "vl", "vl_", "result", "result IS NULL AND date IS NOT NULL"),
        "V29": slot("V29", "vl", "vl_", "date", future),
        "V30": slot("V30", "sh", "shot", "<date date", "on_therapy AND date <= pdate"),
        "V31": slot("V31", "sh", "shot", "dose", "on_therapy AND dose IS NULL AND date IS NOT NULL"),
        "V32": slot("V32", "sh", "shot", "date",
                    "on_therapy AND idx = 1 AND date IS NULL AND dose IS NULL QUALIFY row_number() OVER "
                    "(PARTITION BY site, subject_id ORDER BY copy) = 1"),
        "V33": _row("V33", "'vl_pre_result'", "pre")
        + " FROM sh WHERE on_therapy AND pre IS NULL QUALIFY row_number() OVER "
          "(PARTITION BY site, subject_id ORDER BY copy, idx) = 1",
        "V34": slot("V34", "sh", "shot", "<date date", late),
        "V35": slot("V35", "sh", "shot", "<date date", soon),
        "V36": slot("V36", "sh", "shot", "date", future),
        "V37": slot("V37", "sh", "shot", "date", early),
    }
    on_r = "JOIN r ON r.site = g.site AND r.subject_id = g.subject_id"
    for rule, e in (("V38", "counsel"), ("V39", "screen")):
        full = f"event = '{e}' AND date IS NOT NULL AND outcome IS NOT NULL"
        some = f"event = '{e}' AND (date IS NOT NULL OR outcome IS NOT NULL)"
        group = (
            f"SELECT site, subject_id, bool_and(coalesce({e}_ever = '1', false)) AS all1, "
            f"bool_and(coalesce({e}_ever = '0', false)) AS all0, bool_and({e}_ever IS NULL) AS alln, "
            f"bool_or({some}) AS some_, bool_or({full}) AS full_ FROM ev GROUP BY site, subject_id"
        )
        out[rule] = (
            f"{_row(rule, f"'{e}_ever'", f'r.{e}_ever', alias='r')} FROM ({group}) g {on_r} "
            "WHERE NOT ((all1 AND some_) OR (all0 AND NOT full_) OR (alln AND NOT full_))"
        )
        first = {"V38": "V40", "V39": "V41"}[rule]
        group = (
            f"SELECT site, subject_id, bool_or({full}) AS full_, bool_or({some} AND idx = 1) AS one_ "
            "FROM ev GROUP BY site, subject_id"
        )
        out[first] = (
            _row(first, f"'{e}_1_date'", f"r.{e}_1_date", f"'{e}_1_outcome'", f"r.{e}_1_outcome", alias="r")
            + f" FROM ({group}) g {on_r} WHERE full_ AND NOT one_"
        )
    # Events dated after the prescription, unless an event of the subject excuses them.
    for rule, e in (("V42", "counsel"), ("V43", "screen")):
        after = f"event = '{e}' AND rx = '1' AND date > rx_date"
        excuse = f"NOT coalesce({after}, false)"
        if mode == "default":
            excuse = f"CASE WHEN rx = '1' THEN event = '{e}' AND date <= rx_date ELSE {NEVER_PRESCRIBED} END"
        out[rule] = (
            _row(rule, "'rx_date'", "r.rx_date", f"'{e}_' || CAST(g.idx AS VARCHAR) || '_date'",
                 _pick(e, "date", "g.idx"), alias="r")
            + f" FROM (SELECT site, subject_id, max(idx) AS idx FROM ev WHERE {after} GROUP BY site, subject_id) g {on_r}"
            + f" WHERE (g.site, g.subject_id) NOT IN (SELECT (site, subject_id) FROM ev WHERE {excuse})"
        )
    out["V44"] = _offender(
        "V44", "rx_date", f"CASE WHEN rx = '1' THEN shot1_date < rx_date ELSE NOT {NEVER_PRESCRIBED} END",
        "'rx_date'", "rx_date", "'shot1_date'", "shot1_date",
    )
    for rule, e, wanted in (("V45", "screen", "1"), ("V46", "counsel", "3")):
        against = f"event = '{e}' AND rx = '1' AND outcome <> '{wanted}'"
        among = "" if mode == "strict" else (
            f" WHERE event = '{e}' AND date IS NOT NULL AND outcome IS NOT NULL"
        )
        last = (
            f"SELECT * FROM ev{among} QUALIFY row_number() OVER (PARTITION BY "
            "site, subject_id ORDER BY date DESC NULLS FIRST, copy DESC, eo DESC, idx DESC) = 1"
        )
        highest = f"SELECT site, subject_id, max(idx) AS idx FROM ev WHERE {against} GROUP BY site, subject_id"
        out[rule] = (
            _row(rule, "'rx'", "r.rx", f"'{e}_' || CAST(g.idx AS VARCHAR) || '_outcome'",
                 _pick(e, "outcome", "g.idx"), alias="r")
            + f" FROM ({highest}) g {on_r} WHERE (g.site, g.subject_id) IN "
              f"(SELECT (site, subject_id) FROM ({last}) WHERE {against})"
        )
    out["V47"] = _offender(
        "V47", "discontinued",
        "CASE discontinued WHEN '1' THEN discontinued_date IS NOT NULL AND coalesce(discontinued_date < rx_date, true) "
        "WHEN '0' THEN coalesce(rx_date, shot1_date, shot2_date) IS NULL ELSE discontinued IS NOT NULL END",
    )
    for rule, e in (("V48", "counsel"), ("V49", "screen")):
        dated = (
            f"SELECT *, {future} AS fut, bool_or({future}) OVER (PARTITION BY site, subject_id) AS any_fut "
            f"FROM ev WHERE event = '{e}'"
        )
        out[rule] = (
            f"{_row(rule, f"'{e}_' || CAST(idx AS VARCHAR) || '_date'", 'date')} FROM ({dated}) "
            f"WHERE CASE WHEN any_fut THEN fut ELSE {early} END "
            "QUALIFY row_number() OVER (PARTITION BY site, subject_id, idx ORDER BY copy) = 1"
        )
    for rule, c in (("V50", "rx_date"), ("V51", "discontinued_date")):
        out[rule] = (
            f"{_row(rule, f"'{c}'", c)} FROM ev WHERE {c} > DATE '{AS_OF}' OR {c} < DATE '{NOT_BEFORE}' "
            "QUALIFY row_number() OVER (PARTITION BY site, subject_id ORDER BY copy, eo, idx) = 1"
        )
    return dict(sorted(out.items()))


SHOWN = "subject_id, copy, rule_id, column1, value1, column2, value2"


def found_sql(*rules: str, mode: str = "default", shown: str = SHOWN, **options) -> str:
    """The violations of some rules."""
    every = rule_sql(mode, options.get("n_shots", N_SHOTS))
    union = "\nUNION ALL\n".join(f"SELECT {shown} FROM ({every[r]})" for r in rules)
    return base(**options) + union


# White space at the ends of a cell, and what a cell must look like to be read.
BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _own_clean(c: str) -> str:
    short = f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"
    return f"CASE WHEN {short} NOT IN ({TOKENS}) THEN {short} END"


def _own_number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END"


def _own_date(c: str) -> str:
    """The parts of a date by pattern, checked against the calendar by going to a day and back."""

    def day(pattern: str, y: int, m: int, d: int) -> str:
        part = {n: f"CAST(nullif(regexp_extract({c}, '{pattern}', {n}), '') AS INTEGER)" for n in (1, 2, 3)}
        last = f"CASE WHEN {part[m]} BETWEEN 1 AND 12 THEN day(last_day(make_date({part[y]}, {part[m]}, 1))) END"
        return f"CASE WHEN {part[d]} BETWEEN 1 AND {last} THEN make_date({part[y]}, {part[m]}, {part[d]}) END"

    return (
        f"CASE WHEN contains({c}, '/') THEN {day('^([0-9]{1,2})/([0-9]{1,2})/([0-9]{1,4})', 3, 1, 2)} "
        f"WHEN contains({c}, '-') THEN {day('^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})', 1, 2, 3)} "
        f"ELSE DATE '1899-12-30' + CAST(floor({_own_number(c)}) AS INTEGER) END"
    )


def dirty_base() -> str:
    """Common table expressions: x (cells of many spellings, cleaned) and y (typed)."""
    names = list(dirty_columns())
    clean = ", ".join(f'{_own_clean(f'"{c}"')} AS "{c}"' for c in names)

    def typed(c: str) -> str:
        name = f'"{c}"'
        if "date" in c.lower():
            return f"{_own_date(name)} AS {name}"
        return f"{_own_number(name)} AS {name}" if c in ("cd4_last", "bmi", "age") else name

    rest = ", ".join(typed(c) for c in names if c != "subject_id")
    return f"""WITH x AS (SELECT copy, {clean} FROM ({dirty_sql()})),
y AS (SELECT {_own_number('subject_id')} AS subject_id, subject_id AS subject_id_text, copy, {rest} FROM x)
"""


def optional_codes_sql() -> str:
    def bad(rule: str, column: str, shown: str, cond: str) -> str:
        return (
            f"SELECT subject_id, copy, '{rule}' AS rule_id, '{column}' AS column1, {shown} AS value1, "
            f"CAST(NULL AS VARCHAR) AS column2, CAST(NULL AS VARCHAR) AS value2 FROM y WHERE {cond}"
        )

    keyed = "subject_id IS NOT NULL AND"
    return dirty_base() + " UNION ALL ".join([
        bad("V02", "subject_id", "subject_id_text", "subject_id IS NULL"),
        bad("V06", "gender_id", "gender_id", f"{keyed} gender_id NOT IN ({_codes(*range(1, 6))})"),
        bad("V14", "immigration_status_undoc", "immigration_status_undoc", f"{keyed} immigration_status_undoc NOT IN ({YES_NO})"),
    ])


def any_key_sql() -> str:
    """The second and third viral load under other names, in the same order."""
    renamed = [f"replace(replace({c}, 'vl_2_', 'vl_1.5_'), 'vl_3_', 'vl_baseline_') AS {c}" for c in ("column1", "column2")]
    shown = SHOWN.replace("column1", renamed[0]).replace("column2", renamed[1])
    return found_sql("V17", "V27", "V28", "V29", shown=shown)


def report_cte(site: str = "''", rules: tuple[str, ...] = (), **options) -> str:
    """:func:`base` plus table ``rep``, the full report or that of some rules."""
    texts = ", ".join("('{}', '{}', '{}')".format(rule, *[v.replace("'", "''") for v in t]) for rule, t in TEXTS.items())
    every = rule_sql()
    union = "\nUNION ALL\n".join(f"({every[r]})" for r in rules or every)
    return base(site, **options) + f""", found AS ({union}),
texts(rule_id, description, short_message) AS (VALUES {texts}),
rep AS (SELECT site, subject_id, rule_id, description, column1, value1, column2, value2, short_message,
  CASE WHEN contains(column1, 'date') AND contains(column2, 'date')
       THEN CAST(date_diff('day', TRY_CAST(value1 AS DATE), TRY_CAST(value2 AS DATE)) AS VARCHAR)
  END AS date_difference FROM found JOIN texts USING (rule_id))
"""


REPORT = "subject_id, rule_id, description, column1, value1, column2, value2, short_message, date_difference"
SITE = "concat('site-', CAST(k % 3 AS VARCHAR))"


def oracle_sql() -> dict[str, str]:
    events = (
        "subject_id, copy, event, idx AS index, date, outcome, counsel_ever, screen_ever, rx, rx_date, "
        "anchor_date, discontinued, discontinued_date"
    )
    reasons = " UNION ALL ".join(
        f"SELECT subject_id, copy, '{c}' AS \"column\", {c} AS value, CAST(i - 1 AS INTEGER) AS position, "
        f"trim(string_split({c}, ',')[i]) AS code "
        f"FROM (SELECT *, unnest(range(1, len(string_split({c}, ',')) + 1)) AS i FROM t WHERE {c} IS NOT NULL)"
        for c, _ in REASONS.values()
    )
    profile = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS total_count FROM t"
        for c in PROFILED
    )
    site_profile = base(SITE) + " UNION ALL ".join(
        f"SELECT site, '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS total_count "
        "FROM t GROUP BY site" for c in PROFILED
    )
    # The second run saw half of the second site's rows and none of the third.
    published = {"site": SITE, "where": "k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 0)"}
    rules = ("V01", "V02", "V07", "V36")
    published_report = report_cte(rules=rules, **published)
    published_profile = base(**published) + " UNION ALL ".join(
        f"SELECT site, '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS total_count "
        f"FROM t GROUP BY site" for c in PROFILED
    )
    own = {"site": SITE, "cells": site_cells(), "gender": f"CASE WHEN k % 3 = 2 THEN {GENDER} END"}
    order = "rule_id, subject_id, column1, value1, column2, value2"
    return {
        "null_tokens": base() + f"SELECT subject_id_text, copy, {', '.join(COLUMNS)} FROM cl",
        "key_cast_drop": base() + "SELECT subject_id, subject_id_text, copy FROM t",
        "keyless_rows": found_sql("V02"),
        "parse_mixed_dates": base() + f"SELECT subject_id, copy, {', '.join(DATES)} FROM t",
        "numeric_coerce": base() + "SELECT subject_id, copy, age FROM t",
        "optional_columns": base() + "SELECT subject_id, copy, gender_id, immigration_status_undoc FROM t",
        "select_columns": base()
        + "SELECT subject_id, copy, race_white, race_black, risk_msm, vl_1_result, vl_2_result, vl_3_result, "
          "vl_pre_result, zip_code FROM t",
        "missing_profile": base() + profile,
        "unique_key": found_sql("V01"),
        "domain_violations": found_sql(*DOMAINS),
        "sex_at_birth_domain": found_sql("V07"),
        "reason_tokens": base() + reasons,
        "reason_codes": found_sql(*REASONS),
        "slots_long_vl": base() + "SELECT subject_id, copy, idx AS index, date, result FROM vl0",
        "slots_long_shot": base() + "SELECT subject_id, copy, idx AS index, date, dose, pre AS baseline_result FROM sh0",
        "vl_order": found_sql("V27"),
        "vl_result_missing": found_sql("V28"),
        "vl_future": found_sql("V29"),
        "shot_order": found_sql("V30"),
        "shot_dose_missing": found_sql("V31"),
        "shot_first_missing": found_sql("V32"),
        "shot_baseline_missing": found_sql("V33"),
        "shot_late": found_sql("V34"),
        "shot_early": found_sql("V35"),
        "shot_future": found_sql("V36"),
        "shot_before_approval": found_sql("V37"),
        "events_long": base() + f"SELECT {events} FROM ev",
        "event_ever": found_sql("V38", "V39"),
        "event_first_slot": found_sql("V40", "V41"),
        "rx_before_event": found_sql("V42", "V43"),
        "rx_before_event_strict": found_sql("V42", "V43", mode="strict"),
        "initiate_after_rx": found_sql("V44"),
        "rx_outcome_mismatch": found_sql("V45", "V46"),
        "rx_outcome_mismatch_strict": found_sql("V45", "V46", mode="strict"),
        "discontinuation": found_sql("V47"),
        "extreme_dates": found_sql("V48", "V49", "V50", "V51"),
        "report_full": report_cte() + f"SELECT {REPORT} FROM rep",
        "report_export": report_cte() + f"SELECT {REPORT.replace('short_message, ', '')} FROM rep",
        "report_summary": report_cte()
        + "SELECT short_message, count(*) AS error_count FROM rep GROUP BY short_message",
        "report_filtered": report_cte() + f"SELECT {REPORT} FROM rep WHERE rule_id = 'V34' AND column2 = 'shot2_date'",
        "report_page": report_cte()
        + f"SELECT {REPORT} FROM rep ORDER BY "
        + ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
        + " LIMIT 25 OFFSET 50",
        "report_search": report_cte(rules=("V30", "V34", "V35"))
        + f"SELECT {REPORT.replace('short_message, ', '')} FROM rep WHERE description ILIKE '%injection%' "
          "AND subject_id BETWEEN 100 AND 40000 AND TRY_CAST(value2 AS DATE) BETWEEN DATE '2021-04-01' AND DATE '2021-12-31' "
          "AND TRY_CAST(date_difference AS DOUBLE) <= 20",
        "report_page_deep": report_cte(rules=("V07", "V30", "V34", "V35"))
        + f"SELECT {REPORT} FROM rep ORDER BY "
        + ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
        + " LIMIT 25 OFFSET 975",
        "sites_in_one_pass": report_cte(SITE)
        + "SELECT site, rule_id, count(*) AS error_count FROM rep GROUP BY site, rule_id",
        "site_missing_profile": site_profile,
        "one_site": base(SITE) + f"SELECT {SHOWN} FROM ({rule_sql()['V30']}) WHERE site = 'site-1'",
        "list_sites": base(SITE) + "SELECT DISTINCT site FROM n",
        "csv_cells": base() + f"SELECT subject_id_text, copy, {', '.join(COLUMNS)} FROM cl",
        "own_headers_csv": base(**own)
        + f"SELECT site, subject_id_text, copy, {', '.join(COLUMNS)}, CASE WHEN k % 3 = 2 THEN {GENDER} END AS gender_id FROM cl",
        "own_headers_found": found_sql("V06", "V17", "V22", "V27", "V30", "V36", "V50", shown=f"site, {SHOWN}", **own),
        "published_report": published_report
        + f"SELECT site, {REPORT.replace('short_message, ', '')}, '{AS_OF}' AS run_date FROM rep",
        "published_missing": f"SELECT *, '{AS_OF}' AS run_date FROM ({published_profile})",
        "slots_any_key": any_key_sql(),
        "slots_long_any_key": base()
        + "SELECT subject_id, copy, CASE idx WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.5 END AS index, "
          "CASE idx WHEN 1 THEN '1' WHEN 2 THEN '1.5' ELSE 'baseline' END AS slot, date, result FROM vl0",
        "wide_shots": found_sql("V22", "V30", "V31", "V32", "V33", "V34", "V35", "V36", "V37", n_shots=30),
        "dirty_cells": dirty_base() + "SELECT * FROM y WHERE subject_id IS NOT NULL",
        "optional_codes": optional_codes_sql(),
        "written_report": report_cte(SITE)
        + f"SELECT site, {REPORT.replace('short_message, ', '')}, '{AS_OF}' AS run_date FROM rep",
        "written_missing": f"SELECT *, '{AS_OF}' AS run_date FROM ({site_profile})",
    }
