"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

from importlib import import_module

from sonolith.plans.registry import ORACLES, QUERIES

MODULES = ("ordered", "verbs", "curves", "kernels", "streams", "summaries", "pose", "masks", "modelling", "recordings", "models")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    for m in MODULES:
        import_module(f"sonolith.plans.{m}")
    return QUERIES, ORACLES
