"""DataFrame operators over wide subject tables."""

from cohortcheck.operators.joins import attach
from cohortcheck.operators.keys import repeated_keys
from cohortcheck.operators.neighbours import with_neighbour_rows
from cohortcheck.operators.normalize import Layout, clean_cells, normalize
from cohortcheck.operators.profile import missing_profile
from cohortcheck.operators.reshape import Slot, SlotFamily, explode_codes, to_long

__all__ = [
    "Layout",
    "Slot",
    "SlotFamily",
    "attach",
    "clean_cells",
    "explode_codes",
    "missing_profile",
    "normalize",
    "repeated_keys",
    "to_long",
    "with_neighbour_rows",
]
