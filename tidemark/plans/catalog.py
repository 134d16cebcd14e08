"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark import plans
from tidemark.plans.registry import CHECKS, QUERIES


def _load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{m.name}")


def queries():
    _load()
    return dict(QUERIES)


def checks():
    _load()
    return dict(CHECKS)


def flagship(spark, sf):
    _load()
    return QUERIES["run_experiment"](spark, sf)
