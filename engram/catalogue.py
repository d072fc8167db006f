"""All queries of the engine by name, and the SQL that each must agree with."""

from .plans import case_queries, prompt_queries, source_queries  # noqa: F401  they register their queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
