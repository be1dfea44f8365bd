"""Complete queries over the test tables, each next to its SQL equivalent."""

from framewright.plans import documents, orders  # noqa: F401  (fill the registry)
from framewright.plans.registry import QUERIES

__all__ = ["QUERIES"]
