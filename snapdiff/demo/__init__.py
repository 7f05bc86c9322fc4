"""The operators on the demo tables, with the same queries in SQL."""

from . import changes, ingest, numeric, objects, stored  # noqa: F401  each module registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
