"""All queries of the map engine with their DuckDB twins, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from atriumq.queries import bitmaps, floors, kernels, models, routes

FLAGSHIP = "G01_distances_from_node"


def _modules() -> list:
    return [routes, models, floors, kernels, bitmaps]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.ORACLES
    return out
