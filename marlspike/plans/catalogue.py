"""All named queries of the core."""

from __future__ import annotations

from marlspike.plans import files, linkage, models, movement, prices, shops, texts, topics, tracks

MODULES = [linkage, files, topics, movement, shops, prices, tracks, texts, models]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracles().items()}
