"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from . import cleaning, graphs, links, metrics, tables

MODULES = (cleaning, tables, metrics, links, graphs)


def all_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.REGISTRY.queries.items()}


def all_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.REGISTRY.sql.items()}
