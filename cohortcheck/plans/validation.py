"""The validation plan: which rows go which way, and how findings become report rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortcheck.functions import Selector, any_true, array, one_of, quoted, ref
from cohortcheck.operators.joins import KeyStats, attach, chosen, rows_of
from cohortcheck.operators.keys import N_ROWS, repeated_keys
from cohortcheck.operators.neighbours import with_neighbour_rows
from cohortcheck.operators.normalize import Layout, normalize
from cohortcheck.operators.profile import missing_profile
from cohortcheck.plans.contexts import RowContext, SubjectContext
from cohortcheck.plans.report import assemble
from cohortcheck.plans.rules import CodeListRule, EachFinding, Finding, KeyPresentRule, Rule
from cohortcheck.plans.settings import Settings


@dataclass(frozen=True)
class Pack:
    """A set of rules, and the columns whose missing values are counted."""

    rules: tuple[Rule, ...]
    profiled: tuple[Selector, ...] = ()

    def only(self, *rule_ids: str) -> Pack:
        """The pack with the named rules alone."""
        by_id = {rule.rule_id: rule for rule in self.rules}
        unknown = [r for r in rule_ids if r not in by_id]
        if unknown:
            raise ValueError(f"unknown rule(s): {', '.join(unknown)}")
        return Pack(tuple(by_id[r] for r in rule_ids), self.profiled)

    def profile_columns(self, columns: list[str]) -> list[str]:
        names: list[str] = []
        for selector in self.profiled:
            names += [c for c in selector(columns) if c not in names]
        return names


@dataclass(frozen=True)
class Result:
    """The two result tables, and the values of the ``by`` columns in the input (None without such columns).

    ``report`` is what ``describe`` makes of ``found``, which is shorter and so moved instead.
    """

    report: DataFrame
    missing: DataFrame
    sites: DataFrame | None = None
    found: DataFrame | None = None
    describe: Callable[[DataFrame], DataFrame] | None = None


def validate(df: DataFrame, pack: Pack, settings: Settings, layout: Layout | None = None) -> Result:
    """Check an all-text table against a pack: the report and the missing-value profile."""
    layout = layout or Layout()
    typed = normalize(df, layout, drop_keyless=False)
    keyed = typed.where(f"{ref(layout.subject)} IS NOT NULL")
    profiled = pack.profile_columns(layout.cells(keyed.columns))
    found = violations(typed, pack, settings, layout)

    def describe(part: DataFrame) -> DataFrame:
        return assemble(part, pack.rules, layout)

    return Result(
        describe(found),
        missing_profile(keyed, profiled, layout.by),
        typed.select(*map(ref, layout.by)).distinct() if layout.by else None,
        found.drop(layout.row),
        describe,
    )


def violations(typed: DataFrame, pack: Pack, settings: Settings, layout: Layout) -> DataFrame:
    """Keys, row id, rule id and shown cells of every violation in a normalised table.

    Subjects with one row, and rows without a key, are checked in one pass that moves no row. The
    keys on several rows are found first, from the key and row id columns alone; their rows take a
    second branch, which is left out when there are none or when no rule looks past a row. If the
    keys are too many to be sent around, findings are shuffled, and the columns that the second branch needs.
    """
    keys, row = layout.keys, layout.row
    types = dict(typed.dtypes)
    single = RowContext(types, layout, settings)
    group = SubjectContext(types, layout, settings)
    row_findings = list(_findings(pack.rules, single))
    group_findings = list(_findings(pack.rules, group))
    if not group.grouped:
        return _emit(single.checked(typed), row_findings, pack.rules, layout)

    use_checkpoints(typed.sparkSession)
    repeated = repeated_keys(typed, keys, row).checkpoint()
    stats = KeyStats.of(repeated)
    if stats.keys == 0:
        return _emit(single.checked(typed), row_findings, pack.rules, layout)

    limits = settings.limits
    sizes = (limits.max_broadcast_keys, limits.hot_key_rows, limits.max_broadcast_bytes)
    few = stats.keys <= stats.sendable(limits.max_broadcast_keys, limits.max_broadcast_bytes)
    # Rows stay where they are. Beyond the few, what rows show whose key may repeat is moved, and dropped if it does.
    alone = chosen(typed, repeated, keys, marks=not few, others=True)
    found = _emit(single.checked(alone), row_findings, pack.rules, layout)
    several = chosen(typed, repeated, keys, marks=not few)
    if not few:
        unsure = _emit(single.checked(several), row_findings, pack.rules, layout)
        found = attach(unsure, repeated, keys, row, stats, *sizes, how="anti").unionByName(found)
    needed = [*keys, row, *sorted(group.used - layout.reserved)]
    some = group.with_slots(several, [ref(c) for c in needed])
    if few:
        shared = attach(some, repeated, keys, row, stats, *sizes)
    else:
        shared = rows_of(some, _as_files(repeated), keys)
    if group.aggregates or group.carried or group.by_place:
        # Read twice from here on; finding these rows again would read the whole table again.
        shared = shared.checkpoint()
        # Checkpointed, since its records are measured before they are sent around.
        facts = group.about_subjects(shared).checkpoint()
        if group.carried:
            shared = with_neighbour_rows(
                shared, keys, row, group.carried, stats.rows, stats.largest, limits.chunk_rows
            )
        shared = attach(shared.drop(N_ROWS), facts, keys, row, KeyStats.of(facts), *sizes)
    rows = group.with_pairs(group.with_facts(shared))
    return found.unionByName(_emit(rows, group_findings, pack.rules, layout, keyless=False))


def _findings(rules: Iterable[Rule], ctx: RowContext | SubjectContext) -> Iterable[tuple[str, Finding | EachFinding]]:
    for rule in rules:
        for finding in rule.findings(ctx):
            yield rule.rule_id, finding


def _emit(
    rows: DataFrame,
    findings: list[tuple[str, Finding | EachFinding]],
    rules: Iterable[Rule],
    layout: Layout,
    keyless: bool = True,
) -> DataFrame:
    """One output row per finding that holds.

    All findings share one pass over ``rows``: each is an element of an array column that is null
    unless it holds, and the nulls are dropped as the array unrolls; findings about the elements of an array
    follow them. The array is a column of its own, so that Spark may compile it in small methods; the outer unrolling
    keeps the optimizer from computing it twice to test for emptiness.
    """
    nothing = Finding("false", "''", "''")
    alone = [(rule_id, f) for rule_id, f in findings if isinstance(f, Finding)]
    held = array(_entry(rule_id, f) for rule_id, f in alone or [("", nothing)])
    each = [_entries(rule_id, f) for rule_id, f in findings if isinstance(f, EachFinding)]
    if each:
        held = f"concat({', '.join([held, *each] if alone else each)})"
    if keyless:
        no_key = f"{ref(layout.subject)} IS NULL"
        entries = [_entry(r.rule_id, r.keyless(layout)) for r in rules if isinstance(r, KeyPresentRule)]
        if not entries:
            rows = rows.where(f"NOT {no_key}")
        elif not findings:
            rows, held = rows.where(no_key), array(entries)
        else:
            held = f"CASE WHEN {no_key} THEN {array(entries)} ELSE {held} END"
    keep = [ref(c) for c in (*layout.keys, layout.row)]
    found = rows.selectExpr(*keep, f"{held} AS _held").selectExpr(*keep, "inline_outer(_held)")
    lists = [rule for rule in rules if isinstance(rule, CodeListRule)]
    return _per_bad_code(found.where("rule_id IS NOT NULL"), lists)


def _entries(rule_id: str, each: EachFinding) -> str:
    found = f"filter({each.items}, {each.element} -> {each.finding.when})"
    return f"transform({found}, {each.element} -> {_shown(rule_id, each.finding)})"


def _entry(rule_id: str, finding: Finding) -> str:
    return f"CASE WHEN {finding.when} THEN {_shown(rule_id, finding)} END"


def _shown(rule_id: str, finding: Finding) -> str:
    shown = {
        "rule_id": quoted(rule_id),
        "column1": finding.column1,
        "value1": finding.value1,
        "column2": finding.column2 or quoted(None),
        "value2": finding.value2 or quoted(None),
    }
    fields = ", ".join(f"'{name}', {value}" for name, value in shown.items())
    return f"named_struct({fields})"


def _per_bad_code(found: DataFrame, rules: list[CodeListRule]) -> DataFrame:
    """Repeat the violations of comma-list rules once per bad code."""
    if not rules:
        return found
    ours = one_of("rule_id", [rule.rule_id for rule in rules])
    codes = f"explode(CASE WHEN {ours} THEN split(value1, ',') ELSE array(CAST(NULL AS STRING)) END)"
    bad = any_true(["_code IS NULL", *[rule.bad_code("_code") for rule in rules]])
    return found.selectExpr("*", f"{codes} AS _code").where(bad).drop("_code")


def _as_files(table: DataFrame) -> DataFrame:
    """``table``, written below the checkpoint folder, so that Spark plans with its true size."""
    spark = table.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/keys-{uuid.uuid4()}"
    table.write.parquet(path)
    return spark.read.parquet(path)


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoint where ``spark.checkpoint.dir`` says; a local run without one gets its own folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cohortcheck-")
    context.setCheckpointDir(folder)
