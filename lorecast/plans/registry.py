"""All queries of the core library, by name: (callable, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("references", "cleaning", "monitoring", "retrieval", "relations", "ingest", "questions", "evaluation")


def core_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"lorecast.plans.{name}").QUERIES
    return found
