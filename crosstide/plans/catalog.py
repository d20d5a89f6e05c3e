"""All named queries."""

from crosstide.plans import catalog_events, catalog_factors, catalog_ingest, catalog_scoring, catalog_series, catalog_universe  # noqa: F401
from crosstide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
