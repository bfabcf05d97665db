"""All registered queries."""

from . import catalog_accounts, catalog_chunks, catalog_search, catalog_tables  # noqa: F401, I001
from . import catalog_changes, catalog_rules, catalog_sources, catalog_streams, catalog_views  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
