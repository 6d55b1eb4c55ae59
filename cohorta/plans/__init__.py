"""Registered queries, each with the SQL it is checked against."""

from importlib import import_module

from cohorta.plans.base import QUERIES, SQL

MODULES = ["sources", "filters", "joins", "aggregates", "ordered", "reshape", "scalars", "product", "basket", "experiments", "models", "lake", "streams", "unknown_keys"]

for _module in MODULES:
    import_module(f"cohorta.plans.{_module}")

__all__ = ["QUERIES", "SQL"]
