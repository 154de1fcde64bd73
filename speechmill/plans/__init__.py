"""Queries that apply the operators to the driver's tables, with the same in SQL."""

from . import segment_queries, signal_queries, stage_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
