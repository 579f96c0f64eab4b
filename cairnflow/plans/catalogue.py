"""Every registered query and the SQL that checks it."""

from __future__ import annotations

from cairnflow.plans import q_detect, q_ext, q_flow, q_graph, q_more, q_risk, q_rows, q_stream  # noqa: F401
from cairnflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
