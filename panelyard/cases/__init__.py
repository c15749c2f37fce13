"""Example queries over the test tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tables", "windows", "summaries", "splits", "statistics", "modelling", "sequences", "worked"]


def load_cases():
    """(queries, oracle texts) of all case modules."""
    for name in MODULES:
        import_module(f"panelyard.cases.{name}")
    base = import_module("panelyard.cases.base")
    return base.QUERIES, base.ORACLES
