"""Registered queries: each applies operators to the driver's tables, with the same query as SQL where SQL can say it."""

import importlib

MODULES = ("scans", "filters", "joins", "sequences", "aggregates", "accounting", "ranking", "learning", "text", "streams", "portfolios", "blocks", "ensembles", "files", "disclosures")


def registered(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tidemark.plans.{name}"), attribute)
    return found
