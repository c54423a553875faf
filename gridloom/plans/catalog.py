"""All queries of the engine's own operators."""

from gridloom.plans import extras, geometry, sets, shapes, volumes  # noqa: F401
from gridloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
