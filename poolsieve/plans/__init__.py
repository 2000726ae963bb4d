"""Plans of several operators: the active-learning loop and the named queries."""

from . import pool_queries, score_queries, source_queries, text_queries, token_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "pool_queries", "score_queries", "source_queries", "text_queries", "token_queries"]
