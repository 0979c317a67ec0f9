"""Queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("relational", "sampling", "sequences", "spatial", "metrics", "structure", "cleanup", "templates", "msa", "lookups", "pairing", "symmetry", "permutation", "fingerprints", "events")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quarry.plans.{m}"), name)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
