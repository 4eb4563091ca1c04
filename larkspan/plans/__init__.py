"""Queries over the driver's tables, grouped by area."""

from . import command_queries, job_queries, model_queries, profile_queries, selection_queries, text_queries, workflow_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
