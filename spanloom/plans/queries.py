"""All registered queries of the calendar engine."""

from . import calendar_queries, interval_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "calendar_queries", "interval_queries"]
