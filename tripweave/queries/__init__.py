"""Every registered query; importing the modules fills the registry."""

import importlib

from .registry import ORACLES, QUERIES, forget, oracle_statements, workspace

MODULES = ("usage", "timetable", "catalog", "trips", "journeys", "search", "requests", "feeds", "streams", "reports")

for _module in MODULES:
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES", "forget", "oracle_statements", "workspace"]
