"""Queries registered with the driver and the SQL that must agree with them."""

from __future__ import annotations

from types import ModuleType


def registered() -> list[ModuleType]:
    """The modules that hold QUERIES and ORACLES."""
    from logloom.plans import cases, records, reference

    return [reference, cases, records]
