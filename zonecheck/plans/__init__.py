"""The registered queries and their SQL."""

from . import clean_queries, more_queries, outline_queries, part_queries, source_queries, spatial_queries, text_queries  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
