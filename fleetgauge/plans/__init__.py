"""Registered queries: each operator applied to whole Parquet tables."""

from __future__ import annotations

import importlib
import pkgutil

from fleetgauge.plans.registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        if module.name != "registry":
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(sorted(REGISTRY.items()))
