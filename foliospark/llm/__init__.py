"""Operators for training-data pipelines; nothing else in the library imports them."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
