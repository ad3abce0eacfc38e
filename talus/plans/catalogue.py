"""All registered queries of the hazard operators, with their SQL."""

from talus.plans import composites, crosschecks, live, pixels, places, rain, regions, reports, site  # noqa: F401
from talus.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
