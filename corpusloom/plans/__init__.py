"""The registered queries over the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL

MODULES = ("corpus", "packing", "selection", "ledgers", "series", "arrays", "catalogue", "costs", "numbers", "sources", "streams", "kernels", "runs", "audits", "records", "models")


def _load() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")


def core_queries():
    _load()
    return dict(QUERIES)


def core_sql():
    _load()
    return dict(SQL)
