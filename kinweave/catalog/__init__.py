"""Registered queries, one module per part of the operator inventory."""
import importlib
import pkgutil

from kinweave.catalog.registry import ORACLES, QUERIES


def _load():
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
