"""All registered queries and their checking SQL."""

from __future__ import annotations

import importlib

MODULES = ("text", "linking", "enriching", "vectors", "geography", "searchlog", "results",
           "training", "files", "streams")


def collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"placesearch.plans.{name}")
        for key, value in getattr(module, attribute).items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("SQL")
