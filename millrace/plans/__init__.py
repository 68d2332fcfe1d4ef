"""All queries of the library, with their SQL."""

from millrace.plans import item_queries, search_queries, usage_queries  # noqa: F401
from millrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
