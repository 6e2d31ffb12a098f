"""The registered queries and the SQL each one is checked against."""

from tablehaul.workloads import aggregates, conforming, loads, relational, texts  # noqa: F401
from tablehaul.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
