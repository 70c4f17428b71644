"""All queries and their SQL."""

from . import duplicates, flow, graphs, planning, replies, retrieval, scoring, segments, text, vectors  # noqa: F401  they register
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
