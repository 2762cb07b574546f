"""Loads every query module."""

import importlib

MODULES = ["scalars", "filters", "sources", "entities", "joins", "patterns", "aggregates",
           "windows", "quality", "scoring", "graphs", "documents", "streams"]


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"fraudspark.plans.{module}")
