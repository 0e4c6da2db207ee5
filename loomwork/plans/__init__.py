"""Named queries over the driver's tables, one module per operator group."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "profiles", "corpora", "traces", "sources_code", "search", "automl", "streams", "files",
)


def registries():
    return [import_module(f"loomwork.plans.{name}").registry for name in MODULES]
