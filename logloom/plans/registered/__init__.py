"""All registered queries, grouped by the part of the model they cover."""

from __future__ import annotations

import importlib
from collections.abc import Callable

GROUPS = ["series", "logs", "ingest", "search", "ops", "sql"]


def _merged(attr: str) -> dict:
    out: dict = {}
    for group in GROUPS:
        part = getattr(importlib.import_module(f"{__name__}.{group}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")


def headline() -> list[str]:
    """The queries the benchmark times."""
    return [n for g in GROUPS for n in importlib.import_module(f"{__name__}.{g}").HEADLINE]
