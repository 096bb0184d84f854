"""Import every query module so the registry is complete."""

from __future__ import annotations

from . import q_claims, q_metrics, q_ops, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
