"""The registered queries over the given tables, and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

_FAMILIES = ("reads", "packets", "fleet", "health", "derive", "streams")


def _load() -> None:
    for family in _FAMILIES:
        import_module(f"{__name__}.{family}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
