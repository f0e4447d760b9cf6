"""The queries of this subpackage and their checking SQL."""

from __future__ import annotations

import importlib

MODULES = ("language_id", "exact_dedup", "minhash", "decontaminate", "packing", "quality",
           "url_filter", "suffix_tree", "licenses", "rollups", "quality_rules", "prefix_trie",
           "lexical_search")


def collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"placesearch.llm.{name}"), attribute))
    return found


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("SQL")
