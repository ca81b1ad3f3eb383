"""All queries of the engine by name, and their SQL."""

from . import clip_queries, gait_queries, join_queries, long_queries, scalar_queries  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
