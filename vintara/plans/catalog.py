"""All registered queries and their oracle statements."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("sources", "panel", "economics", "models", "calibration")


def queries() -> dict:
    found: dict = {}
    for group in GROUPS:
        found |= import_module(f"vintara.plans.queries.{group}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in GROUPS:
        found |= import_module(f"vintara.plans.oracle.{group}").STATEMENTS
    return found
