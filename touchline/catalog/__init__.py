"""Runnable queries over the given tables, each with the SQL it must equal."""

from __future__ import annotations

import importlib
import pkgutil

from touchline.catalog.registry import QUERIES


def load_all():
    for mod in pkgutil.iter_modules(__path__):
        if mod.name != "registry":
            importlib.import_module(f"{__name__}.{mod.name}")
    return QUERIES
