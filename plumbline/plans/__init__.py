"""Registered queries: a name, a plan over the tables of a directory, and SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ("search", "rows", "joins", "windows", "texts", "sources", "modules", "index", "expressions", "scopes", "streams", "layouts", "edits", "varied", "upkeep")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"plumbline.plans.{name}")
