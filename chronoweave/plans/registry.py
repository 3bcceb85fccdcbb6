"""Every query by name, with the SQL that must give the same rows."""

from .queries import ORACLES, QUERIES
from . import file_queries, source_queries, state_queries

QUERIES.update(source_queries.QUERIES)
ORACLES.update(source_queries.ORACLES)

__all__ = ["ORACLES", "QUERIES", "file_queries", "state_queries"]
