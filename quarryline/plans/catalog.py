"""The query modules of the core."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

NAMES = ("records", "filters", "joins", "aggregates", "windows", "metrics", "labels", "text", "diffs", "streams")


def modules() -> list[ModuleType]:
    return [import_module(f"quarryline.plans.{n}") for n in NAMES]
