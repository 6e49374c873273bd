"""The cohort table: one wide, all-text row per order, derived from all of ``orders``.

The given tables hold no cohort data, so every registered query derives one (FIXTURES.md §3).
Each column is a SQL expression that Spark and DuckDB read alike; Spark evaluates it through the
DataFrame API, DuckDB through :func:`cohort_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

N_SHOTS = 5
N_VIRAL_LOADS = 3
N_EVENTS = 2
# An order takes 16 bytes in its file and over a kilobyte as a row of cells, so scans of files alone give tasks too much.
ORDERS_PER_TASK = 100_000

# column, lowest code, number of codes
CODED = [
    ("vital_status_alive", 0, 2),
    ("ethnicity_hispanic", 0, 2),
    ("race_white", 0, 2),
    ("race_black", 0, 2),
    ("active_2023", 0, 2),
    ("active_2024", 0, 2),
    ("risk_msm", 0, 2),
    ("sex_birth", 1, 3),
    ("insurance_status", 1, 8),
    ("housing_status", 1, 3),
    ("employment_status", 1, 3),
    ("poverty_level", 1, 4),
    ("language", 1, 8),
    ("incarceration_history", 0, 4),
]


def _h(x: str, seed: int, mod: int) -> str:
    return f"(({x} * 7919 + {seed} * 104729) % {mod})"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _cell(offset: str, style: str) -> str:
    """A date cell in one of three encodings: ISO, month/day/year, spreadsheet serial."""
    day = f"(DATE '2021-02-01' + CAST({offset} AS INT))"
    mdy = f"concat({_text(f'month({day})')}, '/', {_text(f'day({day})')}, '/', {_text(f'year({day})')})"
    return (
        f"CASE {style} WHEN 0 THEN {_text(day)} WHEN 1 THEN {mdy} "
        f"ELSE {_text(f'44228 + CAST({offset} AS INT)')} END"
    )


def cohort_columns(n_shots: int = N_SHOTS) -> dict[str, str]:
    """Column name -> expression over ``k`` (the order, as subject) and ``ok1``, ``ok2``, … (a number per shot)."""
    out: dict[str, str] = {}
    for i, (name, low, mod) in enumerate(CODED, start=1):
        out[name] = (
            f"CASE WHEN {_h('k', i, 29)} = 0 THEN 'UNK' WHEN {_h('k', i, 31)} = 0 THEN '42' "
            f"ELSE {_text(f'{_h('k', i, mod)} + {low}')} END"
        )
    out["zip_code"] = f"CASE WHEN k % 19 <> 0 THEN {_text('10000 + k')} END"
    out["age"] = f"CASE WHEN k % 23 = 0 THEN 'N/A' ELSE {_text(f'18 + {_h('k', 20, 60)}')} END"
    for n in range(1, n_shots + 1):
        ok = f"ok{n}"
        offset = (
            f"(k % 90 + {60 * (n - 1)} + {_h(ok, n, 25)} - 12 "
            f"- 200 * {_flag(f'{ok} % 17 = 0')} + 3000 * {_flag(f'{ok} % 101 = 0')})"
        )
        out[f"shot{n}_date"] = f"CASE WHEN {ok} % 13 <> 0 THEN {_cell(offset, f'({ok} % 3)')} END"
        out[f"shot{n}_dose"] = (
            f"CASE WHEN {ok} % 11 <> 0 THEN CASE WHEN {ok} % 43 = 0 THEN '9' "
            f"ELSE {_text(f'1 + {ok} % 6')} END END"
        )
    for n in range(1, N_VIRAL_LOADS + 1):
        offset = (
            f"(k % 70 + {90 * (n - 1)} - 150 * {_flag(f'{_h('k', n + 30, 13)} = 0')} "
            f"+ 3000 * {_flag(f'{_h('k', n + 40, 97)} = 0')})"
        )
        out[f"vl_{n}_date"] = f"CASE WHEN {_h('k', n + 50, 7)} <> 0 THEN {_cell(offset, '(k % 3)')} END"
        out[f"vl_{n}_result"] = (
            f"CASE WHEN {_h('k', n + 60, 9)} <> 0 THEN {_text(f'1 + {_h('k', n + 60, 7)}')} END"
        )
    out["vl_pre_result"] = "CASE WHEN k % 10 <> 0 THEN '1' END"
    for event, seed in (("counsel", 70), ("screen", 80)):
        out[f"{event}_ever"] = (
            f"CASE WHEN k % 79 = 0 THEN '7' WHEN {_h('k', seed, 5)} = 0 THEN NULL "
            f"WHEN {_h('k', seed, 5)} = 1 THEN '0' ELSE '1' END"
        )
        for n in range(1, N_EVENTS + 1):
            offset = (
                f"(k % 60 - 40 + {30 * (n - 1)} - 400 * {_flag(f'{_h('k', seed + n, 37)} = 0')} "
                f"+ 3000 * {_flag(f'{_h('k', seed + n, 41)} = 0')})"
            )
            out[f"{event}_{n}_date"] = (
                f"CASE WHEN {_h('k', seed + n, 5)} <> 0 THEN {_cell(offset, '(k % 3)')} END"
            )
            code = f"{_h('k', seed + n, 4)} + 1" if event == "counsel" else _h("k", seed + n, 3)
            out[f"{event}_{n}_outcome"] = f"CASE WHEN {_h('k', seed + n + 3, 6)} <> 0 THEN {_text(code)} END"
    out["rx"] = (
        f"CASE WHEN k % 83 = 0 THEN '2' WHEN {_h('k', 90, 6)} = 0 THEN NULL "
        f"WHEN {_h('k', 90, 6)} = 1 THEN '0' ELSE '1' END"
    )
    rx_offset = f"(k % 80 - 10 - 60 * {_flag('k % 53 = 0')})"
    out["rx_date"] = f"CASE WHEN {_h('k', 91, 5)} <> 0 THEN {_cell(rx_offset, '(k % 3)')} END"
    out["discontinued"] = (
        f"CASE WHEN k % 73 = 0 THEN '3' WHEN {_h('k', 92, 4)} = 0 THEN '1' "
        f"WHEN {_h('k', 92, 4)} = 1 THEN '0' END"
    )
    out["discontinued_date"] = (
        f"CASE WHEN {_h('k', 92, 4)} = 0 AND {_h('k', 93, 3)} <> 0 "
        f"THEN {_cell('(k % 400 - 60)', '(k % 3)')} END"
    )
    out["not_elig_1_reason"] = f"CASE {_h('k', 94, 6)} WHEN 0 THEN '1, 3' WHEN 1 THEN '2,11' WHEN 2 THEN '1,,20' END"
    out["disinterest_reason_1"] = f"CASE {_h('k', 95, 6)} WHEN 0 THEN '1,2' WHEN 1 THEN '7, 8' END"
    out["discontinued_reason"] = f"CASE {_h('k', 96, 6)} WHEN 0 THEN '10' WHEN 1 THEN '99' END"
    return out


def _shot_numbers(n_shots: int) -> dict[str, str]:
    """A number per shot from the order and its customer; an order has one shot at least."""
    return {
        f"ok{n}": f"CASE WHEN {n} <= 1 + o_orderkey % {n_shots} THEN o_orderkey + {n - 1} * o_custkey END"
        for n in range(1, n_shots + 1)
    }


def cohort(
    spark: SparkSession, sf_dir: str, n_shots: int = N_SHOTS, where: str = "true", spread: bool = False
) -> DataFrame:
    """The cohort table on Spark, with ``copy`` as its row id, of the orders ``k`` for which ``where`` holds.

    Every order becomes a subject of its own, so the table grows with ``orders``. Nothing is shuffled, or with ``spread`` the two
    numbers of an order are, before they become a row: tasks then hold about ``ORDERS_PER_TASK`` orders, however many there are.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    if spread:
        orders = orders.repartition(max(1, -(-orders.count() // ORDERS_PER_TASK)), "o_orderkey")
    firsts = orders.selectExpr(
        "o_orderkey AS k", *[f"{expr} AS {name}" for name, expr in _shot_numbers(n_shots).items()]
    )
    copies = firsts.where(where).selectExpr(
        "*",
        "explode(array(0, CASE WHEN k % 97 = 0 THEN 1 END, CASE WHEN k % 89 = 0 THEN 2 END)) AS copy",
    ).where("copy IS NOT NULL")
    return copies.selectExpr(
        "CASE WHEN copy = 2 THEN concat('X-', CAST(k AS STRING)) ELSE CAST(k AS STRING) END AS subject_id",
        "copy",
        *[f"{expr} AS {name}" for name, expr in cohort_columns(n_shots).items()],
        "k",
    )


def cohort_sql(n_shots: int = N_SHOTS, where: str = "true") -> str:
    """The same table as DuckDB common table expressions named ``w``, ``c`` and ``f``."""
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in cohort_columns(n_shots).items())
    picks = ", ".join(f"{expr} AS {name}" for name, expr in _shot_numbers(n_shots).items())
    branches = "\n  UNION ALL\n  ".join(
        f"SELECT {key} AS subject_id, {copy} AS copy, * FROM c{where}"
        for key, copy, where in (
            ("CAST(k AS STRING)", 0, ""),
            ("CAST(k AS STRING)", 1, " WHERE k % 97 = 0"),
            ("concat('X-', CAST(k AS STRING))", 2, " WHERE k % 89 = 0"),
        )
    )
    return f"""w AS (SELECT * FROM (SELECT o_orderkey AS k, {picks} FROM orders) WHERE {where}
), c AS (SELECT k,
  {cols}
  FROM w
), f AS (
  {branches}
)"""


# ---- the same cohort as three sites send it, each with columns of its own -------------------------------

SITES = ("site-0", "site-1", "site-2")
SITE_OF = "concat('site-', CAST(k % 3 AS STRING))"
# What a site's table lacks, and what it has besides: column -> expression over ``k``.
LACKS = {"site-0": (), "site-1": ("shot5_date", "shot5_dose"), "site-2": ("vl_3_date", "vl_3_result", "rx_date")}
GENDER = "CAST(1 + k % 7 AS STRING)"


def site_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A table per site: the first as it is, the second with its columns in the other order, the third in capitals, with
    another type of ``copy`` and a column that the others lack."""
    out = {}
    for number, site in enumerate(SITES):
        table = cohort(spark, sf_dir, where=f"k % 3 = {number}")
        names = [c for c in table.columns if c != "k" and c not in LACKS[site]]
        if number == 1:
            names = names[::-1]
        if number == 2:
            cells = [f"CAST({c} AS INT) AS COPY" if c == "copy" else f"{c} AS {c.upper()}" for c in names]
            out[site] = table.selectExpr(*cells, f"{GENDER} AS gender_id")
        else:
            out[site] = table.select(*names)
    return out


def site_cells() -> dict[str, str]:
    """What DuckDB has to see instead of a cell that a site's table lacks."""
    lacking = {c: number for number, site in enumerate(SITES) for c in LACKS[site]}
    return {c: f"CASE WHEN k % 3 <> {number} THEN {c} END" for c, number in lacking.items()}


# ---- cells as people type them ---------------------------------------------------------------------

_YEAR, _MONTH, _DAY = "(2019 + k % 5)", "(1 + k % 12)", "(1 + k % 28)"
_TWO = "concat(CASE WHEN {0} < 10 THEN '0' ELSE '' END, CAST({0} AS STRING))"
_Y, _M, _D = (f"CAST({x} AS STRING)" for x in (_YEAR, _MONTH, _DAY))
_MM, _DD = _TWO.format(_MONTH), _TWO.format(_DAY)
_SERIAL = "CAST(43466 + k % 2000 AS STRING)"
_SPELLINGS = [
    f"concat({_Y}, '-', {_MM}, '-', {_DD})",
    f"concat({_Y}, '-', {_M}, '-', {_D})",
    f"concat({_M}, '/', {_D}, '/', {_Y})",
    f"concat({_MM}, '/', {_DD}, '/', {_Y})",
    f"concat({_M}, '/', {_D}, '/', CAST(20 + k % 5 AS STRING))",
    f"concat({_Y}, '-', {_MM}, '-', {_DD}, ' 10:30:00')",
    f"concat({_M}, '/', {_D}, '/', {_Y}, ' 0:00')",
    f"concat({_Y}, '-', {_MM}, '-', {_DD}, 'T00:00:00Z')",
    _SERIAL,
    f"concat({_SERIAL}, '.75')",
    f"concat({_SERIAL}, '.0')",
    f"concat(chr(160), {_Y}, '-', {_MM}, '-', {_DD}, chr(160), ' ')",
    f"concat({_Y}, '-', {_M}, '-', CAST(29 + k % 5 AS STRING))",
    f"concat({_D}, '/', {_M}, '/', {_Y})",
    "'around March'", "'2021/3/5'", "'2021-03'", "'UNK'", "' 88888 '", "''", "'March-5'", "'-5'",
]
_NUMBERS = [
    "CAST(k % 900 AS STRING)", "concat(' ', CAST(k % 900 AS STRING), chr(9))", "concat(CAST(k % 90 AS STRING), '.5')",
    "concat(CAST(1 + k % 9 AS STRING), 'e2')", "concat(CAST(1 + k % 9 AS STRING), '.25E+1')", "concat('-', CAST(k % 90 AS STRING))",
    "concat('+', CAST(k % 90 AS STRING), '.')", "'.5'", "concat('<', CAST(k % 90 AS STRING))", "'1,200'", "'12 kg'", "'NaN'", "'1d'",
    "'.'", "'e5'", "'999999'", "'N/A'", "concat(chr(160), CAST(k % 90 AS STRING))",
]


def _by_turns(options: list[str], step: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(options))
    return f"CASE (k * {step}) % {len(options)} {cases} END"


def dirty_columns() -> dict[str, str]:
    """Column name -> expression over ``k``: cells in many spellings, and the two columns that a table may lack."""
    return {
        "subject_id": _by_turns(
            ["CAST(k AS STRING)", "concat('  ', CAST(k AS STRING), chr(160))", "concat('+', CAST(k AS STRING))",
             "concat(CAST(k AS STRING), '.0')", "concat(CAST(k AS STRING), 'e0')", "concat('00', CAST(k AS STRING))",
             "concat('#', CAST(k AS STRING))"], 1),
        "visit_date": _by_turns(_SPELLINGS, 1),
        "Date of Birth": _by_turns(_SPELLINGS, 5),
        "cd4_last": _by_turns(_NUMBERS, 1),
        "cd4_date": _by_turns(_SPELLINGS, 7),
        "bmi": _by_turns(_NUMBERS, 5),
        "age": _by_turns(_NUMBERS, 7),
        "gender_id": _by_turns(["'1'", "'5'", "'6'", "' 2 '", "'1.0'", "'UNK'", "'unk'", "NULL"], 1),
        "immigration_status_undoc": _by_turns(["'0'", "'1'", "'2'", "'Unk'", "concat('1', chr(160))"], 1),
    }


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of such cells, a row per order, with ``copy`` as its row id."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k")
    return keys.selectExpr("k AS copy", *[f"{expr} AS `{name}`" for name, expr in dirty_columns().items()])


def dirty_sql() -> str:
    cells = ", ".join(f'{expr} AS "{name}"' for name, expr in dirty_columns().items())
    return f"SELECT k AS copy, {cells} FROM (SELECT o_orderkey AS k FROM orders)"
