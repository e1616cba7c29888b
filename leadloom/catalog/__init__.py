"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from leadloom.catalog.registry import ENTRIES, Entry

_MODULES = ("web", "leads", "search", "outreach", "evaluation", "hunt", "streams")


def load() -> dict[str, Entry]:
    for name in _MODULES:
        importlib.import_module(f"leadloom.catalog.{name}")
    return dict(ENTRIES)
