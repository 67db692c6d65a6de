"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import bazaarlens.plans as _plans
from bazaarlens.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _module not in ("catalog", "registry"):
        importlib.import_module(f"bazaarlens.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
