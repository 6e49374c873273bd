"""Ready-made rule packs."""

from cohortcheck.packs.injectables import CLINICAL_NAMES, SHORT_NAMES, Names, injectables

__all__ = ["CLINICAL_NAMES", "SHORT_NAMES", "Names", "injectables"]
