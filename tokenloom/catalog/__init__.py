"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every catalog module and return the registry."""
    from tokenloom.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry
