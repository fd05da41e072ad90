"""All queries of the engine."""

from voltlake.plans import queries_basic, queries_kernels, queries_relational  # noqa: F401
from voltlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
