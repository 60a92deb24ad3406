"""The queries served by ``__spark_entry__`` and their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ["expressions", "boards", "pages", "roles", "feed"]


def _load() -> None:
    for name in MODULES:
        import_module(f"jobsluice.catalog.{name}")


def queries():
    from jobsluice.catalog.registry import QUERIES
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from jobsluice.catalog.registry import ORACLES
    _load()
    return dict(ORACLES)
