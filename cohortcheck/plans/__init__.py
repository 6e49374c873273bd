"""Rules, the contexts they are evaluated in, and the validation plan."""

from cohortcheck.plans.rules import (
    Bound,
    CellRule,
    CodeListRule,
    EachFinding,
    Finding,
    KeyPresentRule,
    KeyUniqueRule,
    Rule,
    SlotRule,
    SubjectRule,
    interval_rule,
)
from cohortcheck.plans.report import assemble, for_export, report_filter, report_page, summarize
from cohortcheck.plans.search import Between, report_search, rules_that_fit
from cohortcheck.plans.settings import Limits, Settings
from cohortcheck.plans.validation import Pack, Result, validate, violations

__all__ = [
    "Between",
    "Bound",
    "CellRule",
    "CodeListRule",
    "EachFinding",
    "Finding",
    "KeyPresentRule",
    "KeyUniqueRule",
    "Limits",
    "Pack",
    "Result",
    "Rule",
    "Settings",
    "SlotRule",
    "SubjectRule",
    "assemble",
    "interval_rule",
    "for_export",
    "report_filter",
    "report_page",
    "report_search",
    "rules_that_fit",
    "summarize",
    "validate",
    "violations",
]
