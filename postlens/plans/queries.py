"""All registered queries: importing the plan modules fills the registry."""

from __future__ import annotations

from postlens.plans import cleaning, dashboard, extraction, labelling, storage, streams  # noqa: F401
from postlens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
