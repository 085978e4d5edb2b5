"""Registered queries; importing this package registers them all."""

from importlib import import_module
from pkgutil import iter_modules

from tidemark.plans.registry import REGISTERED

for _module in sorted(m.name for m in iter_modules(__path__) if m.name.endswith("_queries")):
    import_module(f"{__name__}.{_module}")

__all__ = ["REGISTERED"]
