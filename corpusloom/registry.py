"""Queries over the driver's tables, by name, with the SQL that must give the same rows."""

from corpusloom.plans import feed_queries as _feed_queries  # noqa: F401
from corpusloom.plans import process_queries as _process_queries  # noqa: F401
from corpusloom.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "lexical_top_chunks"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
