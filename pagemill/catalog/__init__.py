"""All named queries."""

from __future__ import annotations


def _load() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")


def queries() -> dict:
    from pagemill.catalog import base
    _load()
    return dict(base.QUERIES)


def oracles() -> dict:
    from pagemill.catalog import base
    _load()
    return dict(base.ORACLES)
