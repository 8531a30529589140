"""All queries of the exposure engine by name."""

from __future__ import annotations

from . import catalog_graph  # noqa: F401  registers its queries beside those of catalog_tables
from .catalog_tables import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
FLAGSHIP = "pol04_audit_manifests"
