"""All registered queries."""

from tablelab.plans import model_queries, table_queries  # noqa: F401
from tablelab.plans.registry import RUNS, SQL

__all__ = ["RUNS", "SQL"]
