"""Registered queries of the log-evidence operators and the SQL that must give the same rows."""

from siftlog.plans.reports import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
