"""Queries over the driver tables, one or more per operator."""

from . import cellqueries, modelqueries, panelqueries, scans  # noqa: F401
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
