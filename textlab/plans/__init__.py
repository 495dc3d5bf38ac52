"""Query plans: the registered queries and their oracle SQL."""

from .registry import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
