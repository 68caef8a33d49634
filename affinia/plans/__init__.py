"""Registered queries by group; importing the package fills the registry."""

from importlib import import_module
from pkgutil import iter_modules

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")

from affinia.plans.registry import ORACLES, QUERIES  # noqa: E402, F401
