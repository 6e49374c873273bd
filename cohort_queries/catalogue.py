"""The registered queries. Each takes a session and a data folder and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_queries.cohort import N_SHOTS, cohort, dirty, site_tables
from cohortcheck import Layout, Settings, normalize, tune, validate, violations
from cohortcheck.functions import any_of, column, contains
from cohortcheck.operators import clean_cells, explode_codes, missing_profile, to_long
from cohortcheck.packs import SHORT_NAMES, injectables
from cohortcheck.plans import for_export, report_filter, report_page, report_search, rules_that_fit, summarize
from cohortcheck.plans.validation import use_checkpoints
from cohortcheck.sources import (
    choose_site,
    list_sites,
    publish,
    read_cells,
    read_page,
    read_published,
    read_sites,
    stage,
    write_ordered,
    write_result,
)

Query = Callable[[SparkSession, str], DataFrame]

LAYOUT = Layout(row="copy")
BY_SITE = Layout(row="copy", by=("site",))
SETTINGS = Settings(as_of=date(2024, 6, 30))
STRICT = Settings(as_of=date(2024, 6, 30), mode="strict")
PACK = injectables()
DOMAIN_RULES = [f"V{i:02d}" for i in range(3, 24)]


_STAGED: dict[tuple[str, str, tuple[str, ...], int], tuple[str, list[str]]] = {}


def _staged(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = (), n_shots: int = N_SHOTS) -> DataFrame:
    """The all-text cohort as a Parquet table, derived from ``orders`` once per session and folder.

    It stands for the file that a site would send in, so queries start from a scan. With another number of injections
    than usual it holds their columns alone.
    """
    tune(spark)
    use_checkpoints(spark)
    context = spark.sparkContext
    key = (context.applicationId, sf_dir, by, n_shots)
    if key not in _STAGED:
        site = ["concat('site-', k % 3) AS site"] if by else []
        wide = cohort(spark, sf_dir, n_shots, spread=True).selectExpr(*site, "* EXCEPT (k)")
        if n_shots != N_SHOTS:
            wide = wide.select("subject_id", "copy", "vl_pre_result", *contains("shot")(wide.columns))
        path = f"{context.getCheckpointDir()}/cohort-{len(_STAGED)}"
        stage(wide, path, LAYOUT.row, by)
        _STAGED[key] = path, wide.columns
    path, columns = _STAGED[key]
    return read_cells(spark, path).select(*columns)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The all-text cohort."""
    return _staged(spark, sf_dir)


def table_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a site column, in one folder per site."""
    return _staged(spark, sf_dir, ("site",))


def table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and injections of a cohort with thirty of them."""
    return _staged(spark, sf_dir, n_shots=WIDE_SHOTS)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(table(spark, sf_dir), LAYOUT)


def _columns(*names: str) -> Query:
    return lambda spark, sf_dir: _typed(spark, sf_dir).select("subject_id", *names)


def _found(*rules: str, settings: Settings = SETTINGS) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = normalize(table(spark, sf_dir), LAYOUT, drop_keyless=False)
        return violations(typed, PACK.only(*rules), settings, LAYOUT)

    return query


def _report(view: Callable[[DataFrame], DataFrame] = lambda report: report) -> Query:
    return lambda spark, sf_dir: view(validate(table(spark, sf_dir), PACK, SETTINGS, LAYOUT).report)


def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_cells(table(spark, sf_dir), LAYOUT)


def parse_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    return typed.select("subject_id", "copy", *contains("date")(typed.columns))


def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    wanted = (
        (contains("RACE") & ~contains("other"))
        | contains("risk")
        | (contains("vl") & contains("result"))
        | any_of("zip_code", "not_a_column")
    )
    return typed.select("subject_id", "copy", *wanted(typed.columns))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    return missing_profile(typed, PACK.profile_columns(LAYOUT.cells(typed.columns)))


def site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = normalize(table_by_site(spark, sf_dir), BY_SITE)
    return missing_profile(typed, PACK.profile_columns(BY_SITE.cells(typed.columns)), by=("site",))


def reason_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_codes(_typed(spark, sf_dir), contains("reason") & ~contains("oth"), ["subject_id", "copy"])


def slots_long_vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(_typed(spark, sf_dir), SHORT_NAMES.viral_loads, ["subject_id", "copy"])


def slots_long_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["subject_id", "copy", "vl_pre_result AS baseline_result"]
    return to_long(_typed(spark, sf_dir), SHORT_NAMES.shots, keep)


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to the first injection; undated events and subjects without injection are kept."""
    course = column("counsel_ever", "screen_ever", "rx", "rx_date", "discontinued", "discontinued_date")
    typed = _typed(spark, sf_dir)
    keep = ["subject_id", "copy", *course(typed.columns), "shot1_date AS anchor_date"]
    long = to_long(typed, SHORT_NAMES.events, keep)
    return long.where("anchor_date IS NULL OR date IS NULL OR date <= anchor_date")


def sites_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validate(table_by_site(spark, sf_dir), PACK, SETTINGS, BY_SITE).report
    return report.groupBy("site", "rule_id").count().withColumnRenamed("count", "error_count")


def one_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = choose_site(table_by_site(spark, sf_dir), "site-1").drop("site")
    typed = normalize(chosen, LAYOUT, drop_keyless=False)
    return violations(typed, PACK.only("V30"), SETTINGS, LAYOUT)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps its shared data."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort written as CSV, scanned as text and cleaned."""
    path = _folder(spark, "csv")
    table(spark, sf_dir).write.option("header", "true").csv(path)
    cells = read_cells(spark, path, "csv").withColumn(LAYOUT.row, F.col(LAYOUT.row).cast("bigint"))
    return clean_cells(cells, LAYOUT)


def _written(name: str, fmt: str) -> Query:
    """One of the two result tables of all sites, written by site and day and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "written")
        result = validate(table_by_site(spark, sf_dir), PACK, SETTINGS, BY_SITE)
        write_result(result, path, SETTINGS.as_of, fmt=fmt, tables=(name,))
        kinds = dict(getattr(result, name).dtypes)
        back = read_cells(spark, f"{path}/{name}", fmt)
        return back.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in back.columns])

    return query


SITE_RULES = ("V06", "V17", "V22", "V27", "V30", "V36", "V50")


def own_headers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites' tables as CSV with three different headers, read by name and cleaned."""
    path = _folder(spark, "headers")
    for site, cells in site_tables(spark, sf_dir).items():
        cells.write.option("header", "true").csv(f"{path}/site={site}")
    return clean_cells(read_cells(spark, path, "csv"), BY_SITE)


def own_headers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as Parquet, each in a place of its own: violations of some rules at all sites."""
    path = _folder(spark, "schemas")
    tables = site_tables(spark, sf_dir)
    for site, cells in tables.items():
        cells.write.parquet(f"{path}/{site}")
    cells = read_sites(spark, {site: f"{path}/{site}" for site in tables})
    typed = normalize(cells, BY_SITE, drop_keyless=False)
    return violations(typed, PACK.only(*SITE_RULES), SETTINGS, BY_SITE)


PUBLISHED_RULES = ("V01", "V02", "V07", "V36")
# Of what the second run sees, the first site sent nothing new, the second half of its rows, the third none at all.
SECOND_RUN = "k % 3 = 1 AND k % 2 = 0"


def _published(name: str, fmt: str) -> Query:
    """A table as two runs of one day leave it, of which the second checks two sites again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "published")
        pack = PACK.only(*PUBLISHED_RULES)
        every = table_by_site(spark, sf_dir)
        publish(validate(every, pack, SETTINGS, BY_SITE), path, SETTINGS.as_of, fmt=fmt)
        again = every.where("site = 'site-1' AND CAST(replace(subject_id, 'X-', '') AS BIGINT) % 2 = 0")
        result = validate(again, pack, SETTINGS, BY_SITE)
        publish(result, path, SETTINGS.as_of, fmt=fmt, sites=["site-1", "site-2"])
        return read_published(spark, path, name)

    return query


# Slots under keys of any text: a number with a fraction comes between others, a key that is no number last.
ANY_KEYS = {"vl_2_": "vl_1.5_", "vl_3_": "vl_baseline_"}


def _any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir)
    names = {c: ANY_KEYS[c[:5]] + c[5:] for c in cells.columns if c[:5] in ANY_KEYS}
    return cells.withColumnsRenamed(names)


def slots_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = normalize(_any_keys(spark, sf_dir), LAYOUT, drop_keyless=False)
    return violations(typed, PACK.only("V17", "V27", "V28", "V29"), SETTINGS, LAYOUT)


def slots_long_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = normalize(_any_keys(spark, sf_dir), LAYOUT)
    return to_long(typed, SHORT_NAMES.viral_loads, ["subject_id", "copy"], keys=True)


WIDE_SHOTS = 30
WIDE_RULES = ("V22", "V30", "V31", "V32", "V33", "V34", "V35", "V36", "V37")


def wide_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injection rules on a table with thirty injections."""
    typed = normalize(table_wide(spark, sf_dir), LAYOUT, drop_keyless=False)
    return violations(typed, PACK.only(*WIDE_RULES), SETTINGS, LAYOUT)


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, numbers, keys and codes in the many spellings that people use."""
    return normalize(dirty(spark, sf_dir), LAYOUT)


def optional_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on the two columns that a table may lack, where it has them."""
    typed = normalize(dirty(spark, sf_dir), LAYOUT, drop_keyless=False)
    return violations(typed, PACK.only("V02", "V06", "V14"), SETTINGS, LAYOUT)


SEARCHED = {"description": "INJECTION", "rule_id": ["V30", "V34", "V35", "V99"]}


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report, searched by ranges of numbers and dates, text in any case, and a list."""
    path = _folder(spark, "searched")
    result = validate(table(spark, sf_dir), rules_that_fit(PACK, **SEARCHED), SETTINGS, LAYOUT)
    write_result(result, path, SETTINGS.as_of, site="all", tables=("report",))
    report = spark.read.parquet(f"{path}/report").drop("site", "run_date")
    return report_search(
        report, **SEARCHED, subject_id="100 ... 40000", value2="2021-04-01 ... 2021-12-31", date_difference="... 20"
    )


PAGED_RULES = ("V07", "V30", "V34", "V35")


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fortieth page of a report that was written in order."""
    path = _folder(spark, "ordered")
    report = validate(table(spark, sf_dir), PACK.only(*PAGED_RULES), SETTINGS, LAYOUT).report
    write_ordered(report, path, ORDER)
    return read_page(spark, path, number=40, size=25)


ORDER = ["rule_id", "subject_id", "column1", "value1", "column2", "value2"]


def page(report: DataFrame) -> DataFrame:
    return report_page(report, ORDER, number=3, size=25)


def queries() -> dict[str, Query]:
    return {
        "null_tokens": null_tokens,
        "key_cast_drop": _columns("subject_id_text", "copy"),
        "keyless_rows": _found("V02"),
        "parse_mixed_dates": parse_mixed_dates,
        "numeric_coerce": _columns("copy", "age"),
        "optional_columns": _columns("copy", "gender_id", "immigration_status_undoc"),
        "select_columns": select_columns,
        "missing_profile": profile,
        "unique_key": _found("V01"),
        "domain_violations": _found(*DOMAIN_RULES),
        "sex_at_birth_domain": _found("V07"),
        "reason_tokens": reason_tokens,
        "reason_codes": _found("V24", "V25", "V26"),
        "slots_long_vl": slots_long_vl,
        "slots_long_shot": slots_long_shot,
        "vl_order": _found("V27"),
        "vl_result_missing": _found("V28"),
        "vl_future": _found("V29"),
        "shot_order": _found("V30"),
        "shot_dose_missing": _found("V31"),
        "shot_first_missing": _found("V32"),
        "shot_baseline_missing": _found("V33"),
        "shot_late": _found("V34"),
        "shot_early": _found("V35"),
        "shot_future": _found("V36"),
        "shot_before_approval": _found("V37"),
        "events_long": events_long,
        "event_ever": _found("V38", "V39"),
        "event_first_slot": _found("V40", "V41"),
        "rx_before_event": _found("V42", "V43"),
        "rx_before_event_strict": _found("V42", "V43", settings=STRICT),
        "initiate_after_rx": _found("V44"),
        "rx_outcome_mismatch": _found("V45", "V46"),
        "rx_outcome_mismatch_strict": _found("V45", "V46", settings=STRICT),
        "discontinuation": _found("V47"),
        "extreme_dates": _found("V48", "V49", "V50", "V51"),
        "report_full": _report(),
        "report_export": _report(for_export),
        "report_summary": _report(summarize),
        "report_filtered": _report(lambda r: report_filter(r, rule_id="V34", column2="shot2_date")),
        "report_page": _report(page),
        "report_search": searched,
        "report_page_deep": deep_page,
        "sites_in_one_pass": sites_in_one_pass,
        "site_missing_profile": site_profile,
        "one_site": one_site,
        "csv_cells": csv_cells,
        "written_report": _written("report", "parquet"),
        "written_missing": _written("missing", "csv"),
        "own_headers_csv": own_headers_csv,
        "own_headers_found": own_headers_found,
        "published_report": _published("report", "parquet"),
        "published_missing": _published("missing", "csv"),
        "slots_any_key": slots_any_key,
        "slots_long_any_key": slots_long_any_key,
        "wide_shots": wide_shots,
        "dirty_cells": dirty_cells,
        "optional_codes": optional_codes,
        "list_sites": lambda spark, sf_dir: list_sites(table_by_site(spark, sf_dir)),
    }
