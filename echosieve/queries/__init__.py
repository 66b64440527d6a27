"""The engine's operators as queries over a folder of Parquet tables, with their SQL."""

from __future__ import annotations

from . import catalogue, inventory, media, modes, similarity, upkeep, volumes

_MODULES = (similarity, inventory, catalogue, volumes, media, modes, upkeep)


def queries() -> dict:
    """Every query by name."""
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the query's name."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
