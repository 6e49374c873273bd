"""What a validation run may vary besides its rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from cohortcheck.operators.joins import HOT_KEY_ROWS, MAX_BROADCAST_BYTES, MAX_BROADCAST_KEYS
from cohortcheck.operators.neighbours import CHUNK_ROWS


@dataclass(frozen=True)
class Limits:
    """Sizes at which the plan changes; see the operators that use them."""

    max_broadcast_keys: int = MAX_BROADCAST_KEYS
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    hot_key_rows: int = HOT_KEY_ROWS
    chunk_rows: int = CHUNK_ROWS


@dataclass(frozen=True)
class Settings:
    """Dates that rules compare with, and how undecided evidence counts.

    Dates after ``as_of`` lie in the future; ``not_before`` is the day the therapy was approved.
    ``mode`` is ``default`` (rules look at the rows that bear on them) or ``strict`` (every row of
    the subject counts, and an undecided row leaves the whole question undecided).
    """

    as_of: date
    not_before: date = date(2021, 1, 22)
    mode: str = "default"
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if self.mode not in ("default", "strict"):
            raise ValueError("mode must be 'default' or 'strict'")
