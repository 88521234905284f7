"""All registered queries."""

from . import case_queries, ops_queries, search_queries, solve_queries, upkeep_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
