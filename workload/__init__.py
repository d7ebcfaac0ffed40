"""Queries over the given tables, one per operator, each with SQL that must give the same rows."""

from workload import evals, extraction, feedback, ops, plans, review, sources, streams, templates, text  # noqa: F401
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
