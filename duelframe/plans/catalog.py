"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

_TOPICS = ("pairs", "text", "ranking", "evaluation", "monitoring", "lifecycle", "learning", "streams", "sources")


def _merged(kind: str, attribute: str) -> dict:
    out: dict = {}
    for topic in _TOPICS:
        try:
            module = importlib.import_module(f"duelframe.plans.{kind}_{topic}")
        except ModuleNotFoundError as missing:
            if missing.name != f"duelframe.plans.{kind}_{topic}":
                raise
            continue
        out.update(getattr(module, attribute))
    return out


def queries() -> dict:
    return _merged("queries", "QUERIES")


def oracle_sql() -> dict:
    return _merged("oracle", "SQL")
