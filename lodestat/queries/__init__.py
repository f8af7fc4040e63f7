"""Queries over the given tables, one or more per operator."""

import importlib
import pkgutil


def load_all() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module != "registry":
            importlib.import_module(f"{__name__}.{module}")
