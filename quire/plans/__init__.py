"""Registered queries: each wires operators to the tables, beside its SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return importlib.import_module(f"{__name__}.registry")
