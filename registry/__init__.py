"""The registered queries and the SQL that checks them, by topic."""

from registry import anomaly, findings, ingest, patterns, profile, sources  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
