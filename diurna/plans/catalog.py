"""All registered queries."""

from __future__ import annotations

import importlib

from diurna.plans.registry import ENTRIES, Entry

MODULES = ["views", "records", "nights", "rolling", "circadian", "alignment", "rules", "features", "cohort", "exports"]


def entries() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"diurna.plans.{name}")
    return ENTRIES
