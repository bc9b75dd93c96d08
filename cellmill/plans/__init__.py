"""Registered queries of the operator families, with equal SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cells", "stats", "sequences", "kernels", "relations", "questions", "grouped", "streams", "analysis", "helpers", "features", "extras", "tasks", "motion", "files", "manifests")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"cellmill.plans.{module}"), name)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
