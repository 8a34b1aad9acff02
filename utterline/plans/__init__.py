"""Registered queries."""

from . import dialogs, queries, rows, streams, topics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
