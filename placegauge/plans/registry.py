"""All registered queries and their SQL."""

from placegauge.plans.checks import catalog, ingest, places, publishing
from placegauge.plans.checks.base import ORACLES, QUERIES

MODULES = (places, ingest, catalog, publishing)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
