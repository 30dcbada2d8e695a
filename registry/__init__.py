"""All registered queries."""

from registry import files, parsing, reports, rows, scores  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
