"""Import every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["q_outcomes", "q_scalars", "q_aggregates", "q_paired", "q_decision", "q_quality", "q_spatial", "q_sources"]


def registered():
    for module in MODULES:
        importlib.import_module(f"tallyfield.plans.{module}")
    from tallyfield.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
