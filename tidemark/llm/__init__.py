"""Operators for building training data; nothing outside this subpackage imports it."""

import importlib

#: Modules with QUERIES and ORACLE_SQL.
MODULES = (
    "url_filter", "mixing", "decontaminate", "pii", "toxicity", "near_duplicates", "quality_rules", "licenses", "html_extract", "language_id",
    "token_alignment", "embedding_graph", "collocations",
)


def registered(attribute: str) -> dict:
    """QUERIES or ORACLE_SQL of all modules."""
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tidemark.llm.{name}"), attribute)
    return found
