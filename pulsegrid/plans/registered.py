"""Importing this module registers every query."""

import importlib
import pkgutil

import pulsegrid.plans as _plans
from pulsegrid.plans.catalog import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"pulsegrid.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
