"""All registered queries."""

from postloom.plans import (  # noqa: F401
    catalog_indexed,
    catalog_ingest,
    catalog_outreach,
    catalog_sources,
    catalog_streaming,
    catalog_tables,
)
from postloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
