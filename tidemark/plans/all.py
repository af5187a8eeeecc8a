"""Every query of the mirror."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Query

MODULES = ("ingest", "entities", "stream", "reconciliation", "drifting", "snapshots", "measures", "alerting", "timelines", "reading")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    return QUERIES, ORACLES
