"""Data-quality checks for wide, one-row-per-subject cohort tables on Spark."""

from cohortcheck.operators.normalize import Layout, normalize
from cohortcheck.plans import Limits, Pack, Result, Settings, validate, violations
from cohortcheck.session import tune

__all__ = ["Layout", "Limits", "Pack", "Result", "Settings", "normalize", "tune", "validate", "violations"]
