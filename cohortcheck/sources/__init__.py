"""Reading cell tables and writing result tables."""

from cohortcheck.sources.ordered import read_page, write_ordered
from cohortcheck.sources.published import publish, published_runs, read_published, remove_replaced
from cohortcheck.sources.readers import choose_site, list_sites, read_cells, read_sites, stage, union_by_name
from cohortcheck.sources.writers import write_result

__all__ = [
    "choose_site",
    "list_sites",
    "publish",
    "published_runs",
    "read_cells",
    "read_page",
    "read_published",
    "read_sites",
    "remove_replaced",
    "stage",
    "union_by_name",
    "write_ordered",
    "write_result",
]
