"""Registered queries and their SQL twins."""

from . import graphs, models, scores, texts  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
