"""Named queries; each module has ``QUERIES`` and, where SQL can say the same, ``ORACLES``."""

from __future__ import annotations

import importlib
import pkgutil


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
